"""Language identification, words first.

A model holds, per language, log frequencies of its known words and of character n-grams of up to
four characters. A word that the model knows is scored by its frequencies. An unseen word is scored
by the n-grams at each of its places, the longest known one: four characters, else three, two, one.
A text's language has the highest mean over all of its words; ``score`` is the share of that
language once the means are weighed by the number of words (up to ``CERTAIN``).

The model counts the words of all labelled rows that are not held out, and holds the ``most_words`` most
frequent words and ``most_grams`` most frequent n-grams of each length of each language, which bounds its
size in every worker. All texts are scored whole.

Defined results: ``und`` with score 0 for a text that is null or has no letter, and for all texts if
nothing is labelled; equal means go to the first language by name; rows are never dropped.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import held_out
from tideline.session import written

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: Words after which the means count in full.
CERTAIN = 20
#: Vectors of unseen words that a worker keeps.
KEPT = 100_000
#: Different words that a task counts before it hands their counts on.
COUNTED = 200_000


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def _word_counts(rows: DataFrame) -> DataFrame:
    """(label, word, n) over all words of all ``rows`` (label, text)."""

    def handed_on(counts):
        for label, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["label", "word", "n"])

    def run(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts.setdefault(label, Counter()).update(words_of(text.as_py()))
                if sum(map(len, counts.values())) > COUNTED:
                    yield from handed_on(counts)
                    counts = {}
        yield from handed_on(counts)

    return rows.select("label", "text").mapInArrow(run, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n"))


def _most(counts: DataFrame, keys: list[str], what: str, most: int) -> DataFrame:
    return counts.withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), what))).where(F.col("at") <= most).drop("at")


def _triples(counts: DataFrame, what: str, langs: list[str]) -> list[tuple[str, str, int]]:
    """(language, what, n), collected by columns and with one string for each language: rows would take three times the memory."""
    got, same = counts.select("label", what, "n").toArrow(), {x: x for x in langs}
    return list(zip((same[x.as_py()] for x in got.column(0)), (x.as_py() for x in got.column(1)), (x.as_py() for x in got.column(2)), strict=True))


class Model:
    """Languages, rows of log frequencies, and where each known word and n-gram has its row."""

    def __init__(self, langs: list[str], words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.langs = sorted(langs)
        self.word_at, self.word_rows = self._table(words)
        self.gram_at, self.gram_rows = {}, np.zeros((1, len(self.langs)))  # row 0: a character never seen
        for n in range(1, LONGEST + 1):
            at, rows = self._table([g for g in grams if len(g[1]) == n])
            self.gram_at |= {g: i + len(self.gram_rows) for g, i in at.items()}
            self.gram_rows = np.concatenate([self.gram_rows, rows])

    def _table(self, counts):
        names = sorted({x for _, x, _ in counts})
        at, lang = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(self.langs)}
        table = np.full((len(names), len(self.langs)), 0.1)
        for label, x, n in counts:
            table[at[x], lang[label]] += n
        rows = np.log(table / np.maximum(table.sum(0), 1)) if len(names) else table
        return at, rows - rows.mean(1, keepdims=True) if len(names) else rows

    def places(self, word: str) -> list[int]:
        """Rows of the longest known n-gram at each place of a padded word."""
        at, text, out = self.gram_at, f" {word} ", []
        for i in range(len(text) - 1):
            for n in range(LONGEST, 0, -1):
                if (row := at.get(text[i : i + n])) is not None and i + n <= len(text):
                    out.append(row)
                    break
            else:
                out.append(0)
        return out


class Scorer:
    """Scores texts with a model; keeps the vectors of unseen words up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known = len(model.word_rows)
        self.rows = np.concatenate([model.word_rows, np.zeros((KEPT, len(model.langs)))])
        self.at = dict(model.word_at)
        self.end = self.known

    def _learn(self, words: list[str]) -> None:
        if self.end + len(words) > len(self.rows):
            self.at, self.end = dict(self.model.word_at), self.known
            if self.known + len(words) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.known], np.zeros((len(words), self.rows.shape[1]))])
        places = [self.model.places(w) for w in words]
        sizes = np.fromiter(map(len, places), np.int64, len(places))
        sums = np.add.reduceat(self.model.gram_rows[np.concatenate(places)], np.r_[0, np.cumsum(sizes)[:-1]])
        self.rows[self.end : self.end + len(words)] = sums / sizes[:, None]
        self.at.update(zip(words, range(self.end, self.end + len(words)), strict=True))
        self.end += len(words)

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not counts or not self.model.langs:
            return "und", 0.0
        if new := [w for w in counts if w not in self.at]:
            self._learn(new)
            if lost := [w for w in counts if w not in self.at]:  # the table began anew
                self._learn(lost)
        n = np.fromiter(counts.values(), np.float64, len(counts))
        mean = n @ self.rows[[self.at[w] for w in counts]] / n.sum()
        best = int(np.argmax(mean))
        return self.model.langs[best], float(1 / np.exp((mean - mean[best]) * min(n.sum(), CERTAIN)).sum())


def fit(docs: DataFrame, most_words: int = 20_000, most_grams: int = 10_000) -> Model:
    """Learn from all rows of ``docs`` (doc_id, text, lang) with an id and a language that are not held out."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").alias("label"), "text")
    words = written(_word_counts(rows), "words")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    # the n-grams at a place are the beginnings of its longest one, so words are cut into those alone
    longest = F.transform(F.sequence(F.lit(1), F.length(padded)), lambda i: F.substring(padded, i, F.lit(LONGEST)))
    pieces = words.select("label", "n", F.explode(longest).alias("piece")).groupBy("label", "piece").agg(F.sum("n").alias("n"))
    begin = F.transform(F.sequence(F.lit(1), F.length("piece")), lambda n: F.substring(F.col("piece"), F.lit(1), n))
    grams = pieces.select("label", "n", F.explode(begin).alias("gram")).groupBy("label", F.length("gram").alias("size"), "gram").agg(F.sum("n").alias("n"))
    kept = _most(words.where("n > 1"), ["label"], "word", most_words)  # at most most_words rows a language
    langs = [r["label"] for r in rows.select("label").distinct().collect()]
    return Model(langs, _triples(kept, "word", langs), _triples(_most(grams, ["label", "size"], "gram", most_grams), "gram", langs))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, which needs doc_id (bigint) and text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by fit()

    def run(batches):
        scorer = Scorer(shipped.value)
        for b in batches:
            langs, scores = [], []
            for t in b.column(1):
                lang, score = scorer(t.as_py())
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def reject_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``; all columns stay.

    Scores are computed next to each row, so nothing is joined and repeated rows fare alike.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(shipped.value)
        for b in batches:
            keep = [lang != "und" and score >= least for lang, score in (scorer(t.as_py()) for t in b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
