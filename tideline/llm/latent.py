"""Benchmark decontamination by latent semantic retrieval, with exact checks of what it finds.

Passages are vectors of TF-IDF over the benchmark's terms (no other term can add to a product with an
item). Documents are read once into the numbers of those terms, which are written; document frequencies are
counted over all of them. A randomised SVD gives the latent space: the matrix of the passages of all documents
and of the benchmark is multiplied from both sides with a thin random matrix, as sums over tasks, and only
that thin matrix, whose size the benchmark bounds, is orthogonalised on the driver.

Every document is then read whole. If an item may miss m of its words, a text that holds it has eight of
its m + 8 rarest words, and all but m of its words near each other. This prefilter is exact: no other
place could pass the last check. The cosine search then goes over the places that are left, with windows of
the item's own length every eighth of it, and a place is a candidate if one of its windows is at least
``cosine`` like the item in the latent space. A candidate counts if the longest common subsequence of
words between the item and the place covers ``share`` of the item, and if the item's answer is there as
well; from ``sure`` on the subsequence alone is enough. ``COSINE`` was set from items set into real
documents whole, with a fifth or a third of their words replaced by words of other documents, and with words
put between theirs: none of 2,800 was below 0.32, the least of whole ones was 0.88.

The benchmark is a query set: it is taken in blocks of ``block`` items, each broadcast in turn. Words are
runs of letters, digits and underscores in lower case, so case, punctuation and line breaks don't matter.

Defined results: null and empty texts match nothing; items of fewer than ``LEAST`` words must be
there word for word; items without words, and items that have no part in the latent space, match nothing; repeated items are found under each of their
ids; repeated rows are reported as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import written

WORDS = re.compile(r"\w+")
WINDOW, STRIDE, PASSAGE = 48, 16, 32
LEAST = 8
#: Latent dimensions, and further ones that only the SVD uses.
RANK, SPARE = 128, 16
#: Least cosine of a candidate's best window with its item.
COSINE = 0.3
#: Terms in more than this share of the documents carry no weight, unless an item has few others.
COMMON, FEWEST = 0.1, 6
#: Documents that are numbered at once, term numbers of a written row, passages that are multiplied at once and terms that are added in one go.
NUMBERED, ROW, AT_ONCE, LONG = 64, 1 << 20, 4096, 24
ANSWER = re.compile(r"\b(?:answer|antwort|réponse|respuesta)\s*:\s*", re.I)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """Words after the last mark of an answer, or else the last three words."""
    return words_of(ANSWER.split(text)[-1]) if ANSWER.search(text) else words_of(text)[-3:]


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        u = row & at.get(w, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Block:
    """Items of one block, their terms with weights, and passages in the latent space."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words_of(t), answer_of(t)) for i, t in items if words_of(t)]
        self.terms = {w: k for k, w in enumerate(sorted({w for _, ws, _ in self.items for w in ws}))}
        self.idf = self.rarity = np.ones(len(self.terms))
        self.space = np.zeros((len(self.terms), 1))
        self.seeds: dict[str, list[int]] = {}
        self.needed: list[int] = []

    def seed(self, share: float) -> None:
        """What a text that holds ``share`` of an item has at least: words of its rarest ones, and of all of them."""
        seeds, rare, self.needed, self.counts = defaultdict(list), [], [], [Counter(ws) for _, ws, _ in self.items]
        for k, (_, ws, _) in enumerate(self.items):
            missing = int((1 - share) * len(ws) + 1e-9) if len(ws) >= LEAST else 0
            rarest = sorted(self.counts[k], key=lambda w: (-self.rarity[self.terms[w]], w))[: missing + 8]
            self.needed.append((len(rarest) - missing, len(self.counts[k]) - missing, len(ws) - missing))
            rare.append(frozenset(rarest))
            for w in rarest:
                seeds[w].append(k)
        self.seeds = dict(seeds)
        self.reach = -(-(WINDOW + 2 * max((len(ws) for _, ws, _ in self.items), default=0)) // STRIDE) * STRIDE
        self.seed_words, self.own, self.rare = frozenset(seeds), [frozenset(c) for c in self.counts], rare

    def places(self, words: list[str]) -> dict[int, list[int]]:
        """For each item that may be there the starts of the windows around it, every ``STRIDE`` words.

        Nothing that holds enough of an item is left out: with m words missing at most, it has all but m
        of the item's different words within reach, and of the item's words, repeats included, all but m.
        """
        reach = self.reach
        out, parts, near = defaultdict(set), [], set()
        for cut in range(0, max(1, len(words) - reach), 3 * reach):  # stretches that overlap by the longest reach
            part = words[cut : cut + 4 * reach]
            have = set(part)
            present = Counter(chain.from_iterable(map(self.seeds.__getitem__, self.seed_words & have)))
            if items := [k for k, n in present.items() if n >= self.needed[k][0] and len(self.own[k] & have) >= self.needed[k][1]]:
                parts.append((cut, part, items))
                rare = frozenset().union(*(self.rare[k] for k in items if k not in near))
                hits = [(i, w) for i, w in enumerate(part) if w in rare]
                near.update(k for k in items if k not in near and self._together(k, hits))
        for cut, part, items in parts:
            if items := [k for k in items if k in near]:
                own, at = frozenset().union(*(self.own[k] for k in items)), defaultdict(list)
                for i, w in enumerate(part):
                    if w in own:
                        at[w].append(i)
                for k in items:
                    out[k].update(cut + s for s in self._starts(k, at))
        for k in list(out):
            counts, n = self.counts[k], len(self.items[k][1])
            around = lambda s, n=n, counts=counts: Counter(w for w in words[max(0, s - n) : s + WINDOW + n] if w in counts)
            out[k] = [s for s in sorted(out[k]) if sum(min(c, counts[w]) for w, c in around(s).items()) >= self.needed[k][2]]
        return {k: starts for k, starts in out.items() if starts}

    def _together(self, k: int, hits: list[tuple[int, str]]) -> bool:
        """Whether enough different ones of the rarest words of item ``k`` are within reach of each other anywhere in ``hits``."""
        rare, reach, low, held = self.rare[k], WINDOW + 2 * len(self.items[k][1]), 0, Counter()
        hits, n = [h for h in hits if h[1] in rare], self.needed[k][0]
        if not any(b[0] - a[0] < reach for a, b in zip(hits, hits[max(0, n - 1) :], strict=False)):
            return False
        for i, w in hits:
            held[w] += 1
            while hits[low][0] <= i - reach:
                held[hits[low][1]] -= 1
                if not held[hits[low][1]]:
                    del held[hits[low][1]]
                low += 1
            if len(held) >= n:
                return True
        return False

    def _starts(self, k: int, at: dict[str, list[int]]) -> set[int]:
        """Starts of the windows around every place with enough different words of item ``k``."""
        different = self.needed[k][1]
        own = self.own[k] & at.keys()
        reach, low, held, starts = WINDOW + 2 * len(self.items[k][1]), 0, Counter(), set()
        hits = sorted([(i, w) for w in own for i in at[w]])
        for i, w in hits:
            held[w] += 1
            while hits[low][0] <= i - reach:
                held[hits[low][1]] -= 1
                if not held[hits[low][1]]:
                    del held[hits[low][1]]
                low += 1
            if len(held) >= different:
                starts.update(range(max(0, i - reach) // STRIDE * STRIDE, i + 1, STRIDE))
        return starts

    def weigh(self, df: dict[str, int], n: int) -> None:
        counts = np.array([df.get(w, 0) for w in self.terms], np.float64)
        idf = np.log((n + 1) / (counts + 1)) + 0.1
        self.rarity = idf
        keep = counts <= COMMON * n
        for _, ws, _ in self.items:
            own = sorted({self.terms[w] for w in ws}, key=lambda k: counts[k])
            keep[own[:FEWEST]] = True
        self.idf = np.where(keep, idf, 0.0)

    def rows(self, words: list[str]) -> np.ndarray:
        """Terms with weight, in order of their places."""
        ids = np.fromiter((self.terms.get(w, -1) for w in words), np.int64, len(words))
        return ids[(ids >= 0) & (self.idf[ids] > 0)]

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the items' passages of at most ``PASSAGE`` words one after the other, and how many each has."""
        cut = [self.rows(ws[s : s + PASSAGE]) for _, ws, _ in self.items for s in range(0, max(1, len(ws) - PASSAGE // 2), PASSAGE)]
        return np.concatenate(cut), np.array([len(r) for r in cut])

    def gram(self, terms: np.ndarray, sizes: np.ndarray, thin: np.ndarray) -> np.ndarray:
        """A'A times ``thin`` for the unit TF-IDF rows A of passages, which have ``sizes`` of the ``terms`` each.

        Products of AT_ONCE passages are in single precision, their sum is in double precision.
        """
        out, single = np.zeros(thin.shape), thin.astype(np.float32)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for low in range(0, len(sizes), AT_ONCE):
            part, n = terms[ends[low] : ends[min(low + AT_ONCE, len(sizes))]].astype(np.int64), sizes[low : low + AT_ONCE]
            own = self.idf[part] > 0
            cells, tf = np.unique((np.repeat(np.arange(len(n)), n) * len(self.terms) + part)[own], return_counts=True)
            if not len(cells):
                continue
            of, at = np.divmod(cells, len(self.terms))
            row = tf * self.idf[at]
            first, length = _stretches(of)
            row /= np.repeat(np.sqrt(np.add.reduceat(row * row, first)), length)
            row = row.astype(np.float32)
            products = _sums(single, at, row, length)
            order = np.argsort(at, kind="stable")
            first, times = _stretches(at[order])
            out[at[order][first]] += _sums(products, np.repeat(np.arange(len(length)), length)[order], row[order], times)
        return out

    def settle(self, basis: np.ndarray) -> None:
        """Take the latent space; items become unit vectors."""
        self.space = (self.idf[:, None] * basis).astype(np.float32)
        self.vectors = _unit(np.array([self.space[self.rows(ws)].sum(0) for _, ws, _ in self.items], np.float64).reshape(len(self.items), self.space.shape[1]))

    def likeness(self, words: list[str], k: int, starts: list[int]) -> list[float]:
        """For each of the ascending ``starts`` the best cosine of item ``k`` with a window of its length around there."""
        n, out, i = len(self.items[k][1]), [], 0
        step = max(1, n // 8)
        while i < len(starts):
            j = i + 1
            while j < len(starts) and j < i + 64 and starts[j] == starts[j - 1] + STRIDE:  # a stretch of bounded length
                j += 1
            low = max(0, starts[i] - n)
            ids = np.fromiter((self.terms.get(w, -1) for w in words[low : starts[j - 1] + WINDOW + n]), np.int64)
            at = np.flatnonzero(ids >= 0)
            sums = np.concatenate([np.zeros((1, self.space.shape[1])), np.cumsum(self.space[ids[at]], 0, dtype=np.float64)])
            places = np.arange(0, len(ids), step)
            likeness = _unit(sums[np.searchsorted(at, places + n)] - sums[np.searchsorted(at, places)]) @ self.vectors[k]
            own = np.array(starts[i:j]) - low
            first, last = np.searchsorted(places, np.maximum(own - n, 0)), np.searchsorted(places, own + WINDOW, side="right")
            out += [float(likeness[a:b].max(initial=-1.0)) for a, b in zip(first, last, strict=True)]
            i = j
        return out

    def find(self, text: str | None, cosine: float, share: float, sure: float) -> list[tuple[int, float, float]]:
        """(item id, cosine, share of the item) of each item that the text holds."""
        words, out = words_of(text), []
        for k, starts in self.places(words).items():
            item, ws, answer = self.items[k]
            found = [(s, c) for s, c in zip(starts, self.likeness(words, k, starts), strict=True) if c >= cosine]
            best = 0.0
            for start, _ in found:
                region = words[max(0, start - len(ws)) : start + WINDOW + len(ws)]
                if len(ws) < LEAST:
                    got = 1.0 if any(region[i : i + len(ws)] == ws for i in range(len(region))) else 0.0
                else:
                    got = common_subsequence(ws, region) / len(ws)
                    got = got if got >= sure or common_subsequence(answer, region) == len(answer) else 0.0
                best = max(best, got)
                if best == 1.0:
                    break
            if found and best >= share:
                out.append((item, max(c for _, c in found), best))
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _stretches(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of equal values begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return first, np.diff(np.concatenate([first, [len(of)]]))


def _sums(table: np.ndarray, at: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of the rows ``at`` of ``table`` times ``weights``, over stretches of ``lengths`` (1 or more) one after the other.

    The first rows of all stretches are added at once, then the second ones and so on; longer stretches than LONG are cut.
    """
    cuts = -(-lengths // LONG)
    first = np.cumsum(cuts) - cuts
    nth = np.arange(cuts.sum()) - np.repeat(first, cuts)
    low, size = np.repeat(np.cumsum(lengths) - lengths, cuts) + nth * LONG, np.minimum(np.repeat(lengths, cuts) - nth * LONG, LONG)
    order = np.argsort(-size, kind="stable")
    low, more = low[order], np.searchsorted(-size[order], -np.arange(size.max()))  # pieces with more than j rows come first
    out = table[at[low]] * weights[low][:, None]
    for j, n in enumerate(more[1:], 1):
        out[:n] += table[at[low[:n] + j]] * weights[low[:n] + j][:, None]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return np.add.reduceat(out[back], first, axis=0) if len(low) > len(lengths) else out[back]


def _numbered(docs: DataFrame, block: Block) -> DataFrame:
    """(n, df, terms, sizes) of all ``docs`` (text), written: numbers of the block's terms and how many each passage of ``WINDOW`` words has.

    A row holds many documents. ``n`` and ``df``, the documents of the task and how many of them have each term, are in its last row.
    """
    shipped, size = docs.sparkSession.sparkContext.broadcast(block.terms), len(block.terms)
    kind = np.uint16 if size < 1 << 16 else np.int32

    def row(n, df, held):
        terms, sizes = (np.concatenate(c) if c else np.empty(0) for c in zip(*held, strict=True)) if held else (np.empty(0), np.empty(0))
        cells = [None if df is None else df.tobytes(), terms.astype(kind).tobytes(), sizes.astype(np.uint8).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names=["n", "df", "terms", "sizes"])

    def run(batches):
        get, df, n, held, many = shipped.value.get, np.zeros(size, np.int64), 0, [], 0
        for b in batches:
            n += b.num_rows
            for low in range(0, b.num_rows, NUMBERED):
                texts = [words_of(t.as_py()) for t in b.column(0).slice(low, NUMBERED)]
                lengths = np.array([len(ws) for ws in texts])
                terms = np.fromiter(map(get, chain.from_iterable(texts), repeat(-1)), np.int32, lengths.sum())
                known = np.flatnonzero(terms >= 0)
                terms, doc = terms[known], np.repeat(np.arange(len(texts)), lengths)[known]
                has = np.zeros((len(texts), size), bool)
                has[doc, terms] = True
                df += has.sum(0)
                passages = -(-lengths // WINDOW)
                before = np.cumsum(passages) - passages
                of = before[doc] + (known - (np.cumsum(lengths) - lengths)[doc]) // WINDOW
                held.append((terms, np.bincount(of, minlength=passages.sum())))
                many += len(terms)
                if many > ROW:
                    yield row(None, None, held)
                    held, many = [], 0
        yield row(n, df, held)

    return written(docs.select("text").mapInArrow(run, "n bigint, df binary, terms binary, sizes binary"), "numbered")


def _frequencies(numbered: DataFrame, block: Block) -> tuple[dict[str, int], int]:
    """In how many of all documents each of the block's terms is; the number of documents."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                df = np.frombuffer(b.column(0)[r].as_buffer(), np.int64)
                k = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df[k])], names=["term", "n"])

    last = numbered.where("df IS NOT NULL")
    rows = last.select("df").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per term of the block
    names = list(block.terms)
    return {names[r["term"]]: r["n"] for r in rows}, last.agg(F.sum("n")).first()[0] or 0


def _space(numbered: DataFrame, block: Block, seed: int) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of all passages, by a randomised SVD."""
    spark = numbered.sparkSession
    width = min(RANK + SPARE, len(block.terms))
    kind = np.uint16 if len(block.terms) < 1 << 16 else np.int32
    own = block.passages()

    def product(thin: np.ndarray) -> np.ndarray:
        shipped = spark.sparkContext.broadcast((block, thin))

        def run(batches):
            b_, t_ = shipped.value
            total = np.zeros_like(t_)
            for b in batches:
                for r in range(b.num_rows):
                    total += b_.gram(np.frombuffer(b.column(0)[r].as_buffer(), kind), np.frombuffer(b.column(1)[r].as_buffer(), np.uint8).astype(np.int64), t_)
            k = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(total[k]), pa.list_(pa.float64()))], names=["term", "row"])

        parts = numbered.select("terms", "sizes").mapInArrow(run, "term bigint, row array<double>")
        sums = F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(width)])
        out = block.gram(*own, thin)
        got = parts.groupBy("term").agg(sums.alias("row")).toArrow()  # terms of the block
        for part in got.to_batches():
            out[part.column(0).to_numpy()] += part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
        return out

    thin = np.random.default_rng(seed).standard_normal((len(block.terms), width))
    for _ in range(2):
        thin, _ = np.linalg.qr(product(thin))
    values, turn = np.linalg.eigh(thin.T @ product(thin))
    return thin @ turn[:, np.argsort(-values)[:RANK]]


def prepare(docs: DataFrame, benchmark: DataFrame, block: int = 2000, seed: int = 3) -> list[Block]:
    """One block for every ``block`` items of ``benchmark`` (item_id, text), fitted to ``docs`` (doc_id, text)."""
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("text IS NOT NULL")
    parts = max(1, -(-items.count() // block))
    out = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # about ``block`` rows
        one = Block(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in rows))
        if one.terms:
            numbered = _numbered(docs, one)
            one.weigh(*_frequencies(numbered, one))
            one.settle(_space(numbered, one, seed))
        else:
            one.settle(np.zeros((0, 1)))
        out.append(one)
    return out


def matches(docs: DataFrame, blocks: list[Block], cosine: float = COSINE, share: float = 0.6, sure: float = 0.8) -> DataFrame:
    """(doc_id, item_id, cosine, overlap) of each document and item it holds."""
    spark, schema, out = docs.sparkSession, "doc_id bigint, item_id bigint, cosine double, overlap double", None
    for one in blocks:
        one.seed(share)
        shipped = spark.sparkContext.broadcast(one)  # bounded by the block's items

        def run(batches, shipped=shipped):
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in shipped.value.find(t.as_py(), cosine, share, sure)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "cosine", "overlap"])

        found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = 0.6, sure: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay, and nothing is joined."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for one in prepare(docs, benchmark):
        one.seed(share)
        shipped = spark.sparkContext.broadcast(one)

        def run(batches, shipped=shipped):
            for b in batches:
                yield b.filter(pa.array([not shipped.value.find(t.as_py(), cosine, share, sure) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
