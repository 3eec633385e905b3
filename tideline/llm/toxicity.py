"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled texts: words, and stems (first letters of words), that toxic
texts hold and clean ones hardly do, more often than chance would have it among so many terms. A word
must follow several different words and a stem begin several, so that a copied text does not make
its rare words toxic. It is kept as a trie. The Levenshtein automaton of distance 1 (2 for long
terms) is intersected with the trie, as one deterministic automaton whose states are built when a
word first needs them; most words leave it after a few letters. A misspelt term counts as a fuzzy
hit unless the word itself is known from clean texts.

Each hit is seen in a window of words. Quotation marks around it and words of reporting speak for
quotation, other hits near it and words of address for abuse. A logistic model over these counts,
drawn towards stated weights where labels are few, gives the score.

Sample and lexicon are bounded by documented parameters (``per_label`` texts of each label,
``most_terms`` terms), which bounds what the workers hold; every text is scored whole. Defined
results: null and empty texts, and all texts if no label is given, get the score of a text without
hits; a document labelled twice counts as toxic if any label says so; rows are never dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded_sample, held_out
from tideline.llm.langid import LETTERS, words_of
from tideline.session import written

STEMS = (4, 5, 6, 7, 8)
WINDOW = 6
#: States of the automaton and words that a worker keeps.
STATES, KEPT = 15_000, 150_000
QUOTES = re.compile("[\"'«»“”„‟‘’‹›]")
# Words of reporting and of address in four languages.
REPORTING = frozenset("said says say called calls quoted quote wrote word term sagte sagt nannte schrieb zitat wort dit appelle cite mot terme dijo dice palabra cita".split())
ADDRESS = frozenset("you your are du dich dein ihr bist tu toi vous es eres usted tus".split())
FEATURES = ("words", "stems", "fuzzy", "quoted", "reported", "addressed", "crowded")
# The weights without labels, last the constant.
PRIOR = np.array([6.0, 6.0, 5.5, 1.0, -0.7, 0.3, 0.5, -3.5])


class Automaton:
    """Levenshtein automata of all terms intersected with their trie, made deterministic step by step."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # edits that the term ending here allows
        self.stem: list[bool] = [False]
        for term in words:
            self.ends[self._add(term)] = 0 if len(term) < 5 else 1 if len(term) < 9 else 2
        for term in stems:
            self.stem[self._add(term)] = True
        self.reach = [0] * len(self.child)  # most edits that any term below allows
        for v in range(len(self.child) - 1, -1, -1):
            self.reach[v] = max([self.ends[v], *(self.reach[w] for w in self.child[v].values())])
        self._restart()

    def _add(self, term: str) -> int:
        v = 0
        for c in term:
            if c not in self.child[v]:
                self.child[v][c] = len(self.child)
                self.child.append({})
                self.ends.append(-1)
                self.stem.append(False)
            v = self.child[v][c]
        return v

    def _restart(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []  # of 4 * node + edits
        self.steps: list[dict[str, int]] = []
        self.first = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The state of trie nodes with their least edits so far; letters of terms may be left out."""
        todo = list(at.items())
        while todo:
            v, e = todo.pop()
            if at[v] < e:
                continue
            for w in self.child[v].values():
                if e < self.reach[w] and e + 1 < at.get(w, 99):
                    at[w] = e + 1
                    todo.append((w, e + 1))
        key = tuple(sorted(4 * v + e for v, e in at.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for v, e in map(divmod, self.sets[state], repeat(4)):
            if (w := self.child[v].get(c)) is not None:
                at[w] = min(e, at.get(w, 99))
            if e < self.reach[v]:
                at[v] = min(e + 1, at.get(v, 99))
            for w in self.child[v].values():
                if e < self.reach[w]:
                    at[w] = min(e + 1, at.get(w, 99))
        out = self._state(at) if at else -1
        self.steps[state][c] = out
        return out

    def look_up(self, word: str) -> str | None:
        """'words' or 'stems' for an exact hit, 'fuzzy' for a term within its distance, else None."""
        if len(self.sets) > STATES:
            self._restart()
        state, v = self.first, 0
        for c in word:
            if v >= 0:
                v = self.child[v].get(c, -1)
                if v >= 0 and self.stem[v]:
                    return "stems"
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return None
        if v >= 0 and self.ends[v] >= 0:
            return "words"
        return "fuzzy" if any(x % 4 <= self.ends[x // 4] for x in self.sets[state]) else None


class Lexicon:
    """Terms, words known to be clean, and the weights of the features."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems, self.clean, self.weights = sorted(words), sorted(stems), frozenset(), PRIOR


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.words, lexicon.stems)
        self.seen: dict[str, str | None] = {}

    def kind(self, word: str) -> str | None:
        if word in self.seen:
            return self.seen[word]
        found = self.automaton.look_up(word)
        found = None if found == "fuzzy" and word in self.lexicon.clean else found
        if len(self.seen) >= KEPT:
            self.seen.clear()
        self.seen[word] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of one more than the counts of ``FEATURES``."""
        text = (text or "").lower()
        out = dict.fromkeys(FEATURES, 0)
        if hits := {w for w in set(LETTERS.findall(text)) if self.kind(w)}:
            spans = [(m.group(), m.start(), m.end()) for m in LETTERS.finditer(text)]
            at = [i for i, s in enumerate(spans) if s[0] in hits]
            for k, i in enumerate(at):
                word, start, end = spans[i]
                left, right = spans[max(0, i - WINDOW)][1], spans[min(len(spans) - 1, i + WINDOW)][2]
                near = {spans[j][0] for j in range(max(0, i - WINDOW), min(len(spans), i + WINDOW + 1))}
                quoted = bool(QUOTES.search(text, left, start) and QUOTES.search(text, end, right))
                out["quoted" if quoted else self.kind(word)] += 1
                out["reported"] += bool(near & REPORTING)
                out["addressed"] += bool(near & ADDRESS)
                out["crowded"] += k > 0 and i - at[k - 1] <= WINDOW
        return np.log1p(np.array([out[f] for f in FEATURES], np.float64))

    def __call__(self, text: str | None) -> float:
        w = self.lexicon.weights
        return float(1 / (1 + np.exp(-(self.features(text) @ w[:-1] + w[-1]))))


def _labelled(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """(label, text) of the sample; of rows that repeat an id the text with the smallest digest."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = bounded_sample(rows, "toxic", per_label)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("row"), "text")).alias("one"))
    return written(one.select("label", "one.text"), "sample")  # ``per_label`` rows a label


def _term_counts(sample: DataFrame) -> DataFrame:
    """(stem, term, toxic, clean): in how many texts of each label a word or stem is."""

    def rows(counts):
        terms = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array([t[0] for t in terms], pa.bool_()), pa.array([t[1] for t in terms], pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["stem", "term", "toxic", "clean"])

    def run(batches):
        counts = {0: Counter(), 1: Counter()}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = set(words_of(text.as_py()))
                counts[label].update((False, w) for w in words)
                counts[label].update({(True, w[:n]) for w in words for n in STEMS if len(w) > n})
                if sum(map(len, counts.values())) > KEPT:
                    yield rows(counts)
                    counts = {0: Counter(), 1: Counter()}
        yield rows(counts)

    return sample.mapInArrow(run, "stem boolean, term string, toxic bigint, clean bigint").groupBy("stem", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(toxic: DataFrame, terms: set[tuple[bool, str]]) -> DataFrame:
    """(stem, term, n): how many different words precede each word of ``terms``, or have each stem."""

    def run(batches):
        for b in batches:
            pairs = set()
            for text in b.column(0):
                words = words_of(text.as_py())
                for before, w in zip(["", *words], words, strict=False):
                    pairs.update((k, t, x) for k, t, x in ((False, w, before), *((True, w[:n], w) for n in STEMS if len(w) > n)) if (k, t) in terms)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], names=["stem", "term", "before"])

    return toxic.select("text").mapInArrow(run, "stem boolean, term string, before string").distinct().groupBy("stem", "term").agg(F.count("*").alias("n"))


def _fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a normal prior around ``PRIOR``."""
    x = np.column_stack([x, np.ones(len(x))])
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 5000, most_terms: int = 5000, contexts: int = 3) -> Lexicon:
    """Learn from ``labels`` (doc_id, toxic) and ``docs`` (doc_id, text), without the held-out documents."""
    sample = _labelled(docs, labels, per_label)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(1):
        return Lexicon([], [])
    counts = _term_counts(sample)
    odds = sizes[1] / max(sizes.get(0, 0), 1)
    # A term without any meaning is in k toxic texts and no clean one with odds share ** k; with so many terms, none should be.
    least = max(contexts, int(np.ceil(np.log(2.0 * max(counts.count(), 1)) / np.log(1 + 1 / odds))))
    pure = (F.col("toxic") >= least) & (F.col("clean") * odds <= 0.05 * F.col("toxic")) & (F.length("term") >= 3)
    rows = counts.where(pure).orderBy(F.desc("toxic"), "stem", "term").limit(4 * most_terms).collect()
    found = {(r["stem"], r["term"]) for r in rows}
    several = {(r["stem"], r["term"]) for r in _contexts(sample.where("label = 1"), found).where(F.col("n") >= contexts).collect()}
    terms = [r for r in rows if (r["stem"], r["term"]) in several][:most_terms]
    stems = {r["term"] for r in terms if r["stem"]}
    covered = lambda t: any(t[:n] in stems for n in STEMS if n < len(t))
    # Words with a stem stay, so that misspelt first letters are found; the stem only adds exact beginnings.
    lexicon = Lexicon([r["term"] for r in terms if not r["stem"]], [t for t in stems if not covered(t)])

    def near(batches):
        scorer = Automaton(lexicon.words, lexicon.stems)
        for b in batches:
            got = [w for w in b.column(0).to_pylist() if scorer.look_up(w) == "fuzzy"]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["term"])

    # Words of a single clean text still count as hits, so that the weight of fuzzy hits is learned.
    clean = counts.where("NOT stem AND clean > 1").select("term").mapInArrow(near, "term string")
    lexicon.clean = frozenset(r["term"] for r in clean.collect())  # words of the bounded sample that are near a term

    def measure(batches):
        scorer = Scorer(lexicon)
        for b in batches:
            x = [scorer.features(t.as_py()).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    seen = sample.mapInArrow(measure, "label int, x array<double>").collect()  # of the bounded sample
    x, y = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], np.float64)
    rank = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    lexicon.weights = _fit_weights(x[rank], y[rank])
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, which needs doc_id (bigint) and text."""
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)  # its size is bounded by fit()

    def run(batches):
        scorer = Scorer(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
