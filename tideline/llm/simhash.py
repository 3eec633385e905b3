"""SimHash fingerprints and near-duplicate groups by tiled exact comparison.

A fingerprint bit is set where over half of the shingle hashes have it. A fingerprint has 64 bits, or
several words of 64, whose hashes are mixed anew for each word. Equal fingerprints are merged first,
so copies cost nothing further. Each fingerprint is then put under its value in every block of
bits, and the fingerprints under one value are compared in tiles: numpy exclusive-or and bit counts
over all pairs of a tile pair. Tiles hold a band of population counts (split further by a hash where
there are many), and tile pairs whose population counts differ beyond the radius are never formed. A
value with few fingerprints is one tile; a value that holds a large share of all rows becomes many tile
pairs that are spread over tasks. Of a tile pair only a spanning forest of its links is passed on,
which connects the same fingerprints.

With more blocks than the radius, as for 64 bits within 3, no link is lost: two fingerprints agree
in one block at least. For shingle similarities such as 0.8 ``one_of_each_group`` uses fingerprints
of 512 bits only to search for candidates, in 48 blocks of 10 or 11 bits and with a radius of three
standard deviations more than the bits that differ at the threshold: of two texts whose shingle sets have
Jaccard similarity J, a bit differs with probability p = arccos(2J / (1 + J)) / pi, so all blocks
differ with probability 0.0001 at J = 0.8, and the radius misses 0.0013. Every candidate is then verified by
the exact Jaccard similarity of the two shingle sets.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like
any other; rows that repeat an id and text share their row's result; a null doc_id is never a
component_id unless all members' ids are null.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORD, tasks
from tideline.llm.components import components
from tideline.session import written, written_alone

BITS = 64
#: Fingerprints of one block value that are compared as one tile, and the most of a tile elsewhere.
TILE = 2048
#: Values of all blocks up to which their counts are broadcast.
BROADCAST = 1 << 17
#: What a hash is multiplied by for each further word of a fingerprint.
MIX = 0x9E3779B97F4A7C15
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(WORD.encode())


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of all shingles of ``width`` words, repeats included; the whole sequence if it is shorter."""
    words = _WORDS.findall((text or "").encode().translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    lists = [words[i:] for i in range(width)]
    return np.fromiter((h(s, seed) for s in map(b" ".join, zip(*lists, strict=False))), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """Bits set in over half of the hashes, as signed 64-bit words."""
    out = []
    for word in range(words):
        counts = np.zeros(BITS, np.int64)
        for start in range(0, len(hashes), 1 << 16):
            part = hashes[start : start + (1 << 16)]
            if word:
                part = (part ^ (part >> np.uint64(29))) * np.uint64((MIX * (2 * word + 1)) % (1 << 64))
                part ^= part >> np.uint64(32)
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(hashes)).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``, which needs doc_id (bigint) and text; fp is a bigint, or an array of ``words``."""
    kind, arrow = ("bigint", pa.int64()) if words == 1 else ("array<bigint>", pa.list_(pa.int64()))

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), width, seed), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in fps] if words == 1 else fps, arrow)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, fp {kind}")


def set_fingerprints(docs: DataFrame, width: int, seed: int, words: int) -> DataFrame:
    """(doc_id, row, fp): fingerprints of the distinct shingles, with a digest of their set as one more word; ``row`` tells an id's texts apart."""

    def run(batches):
        for b in batches:
            fps = []
            for t in b.column(1):
                own = np.unique(shingle_hashes(t.as_py(), width, seed))
                fps.append([*fingerprint(own, words), xxhash.xxh64_intdigest(own.tobytes(), seed) - (1 << 63)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "row", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id bigint, row bigint, fp array<bigint>")


def shingle_sets(docs: DataFrame, rows: DataFrame, width: int, seed: int) -> DataFrame:
    """(fp, hashes): the distinct shingle hashes of the texts that ``rows`` (doc_id, row, fp) names, one text for each fp."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width, seed)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "hashes"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    found = texts.join(rows, F.col("id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("row"))).select("fp", "text")
    return found.mapInArrow(run, "fp array<bigint>, hashes array<bigint>").groupBy("fp").agg(F.first("hashes").alias("hashes"))


def _tiled(fps: DataFrame, radius: int, words: int, blocks: int) -> DataFrame:
    """(pair, part, fp): the fingerprints of each tile pair; part tells its two sides, or 0 for one tile alone.

    ``blocks`` is the number of blocks in each word. A pair's name is a hash; should two names meet,
    their fingerprints are compared with each other too.
    """
    parts = [F.col("fp")] if words == 1 else [F.element_at("fp", i + 1) for i in range(words)]
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    values = [F.shiftrightunsigned(F.shiftleft(x, BITS - b), BITS - b + a) for x in parts for a, b in zip(edges, edges[1:], strict=False)]
    pop = sum((F.bit_count(x) for x in parts[1:]), F.bit_count(parts[0]))
    rows = fps.select("fp", F.floor(pop / (radius + 1)).cast("int").alias("band"), F.posexplode(F.array(*values)).alias("block", "value"))
    counts = rows.groupBy("block", "value", "band").agg(F.count("*").alias("n"))
    cuts = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / TILE).cast("int"))))  # a few bands
    counts = counts.groupBy("block", "value").agg(F.sum("n").alias("total"), cuts.alias("tiles"))
    counts = counts.where("total > 1")
    most = len(parts) * sum(1 << (b - a) for a, b in zip(edges, edges[1:], strict=False))  # values of all blocks, whatever the rows
    rows = rows.join(F.broadcast(counts) if most <= BROADCAST else counts, ["block", "value"])
    small = rows.where(F.col("total") <= TILE).select(F.xxhash64("block", "value").alias("pair"), F.lit(0).alias("part"), "fp")
    own = F.struct(F.col("band"), F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("band"))).cast("int").alias("cut"))
    near = F.filter(F.sequence(F.col("band") - 1, F.col("band") + 1), lambda p: F.map_contains_key("tiles", p))
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), F.element_at("tiles", p) - 1), lambda c: F.struct(p.alias("band"), c.cast("int").alias("cut")))))
    large = rows.where(F.col("total") > TILE).select("block", "value", "fp", own.alias("own"), F.explode(others).alias("other"))
    names = [f(F.col("own"), F.col("other")) for f in (F.least, F.greatest)]
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return small.unionAll(large.select(F.xxhash64("block", "value", *names).alias("pair"), side.alias("part"), "fp"))


def _forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """The links among (a, b) that join two trees of ``parent``, which is updated."""
    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        i, j = x, y
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append((x, y))
    return kept


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose words are along the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32) if a.shape[-1] > 1 else np.bitwise_count(a[..., 0] ^ b[..., 0])


def compare(fps: np.ndarray, part: np.ndarray, radius: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Rows of a spanning forest of the links within a tile (part 0) or between its two sides (1 and 2).

    With ``label`` all links between rows of different labels instead.
    """
    parent, kept = np.arange(len(fps)), []
    left = np.flatnonzero(part != 2)
    right = np.flatnonzero(part != 1)
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        a, b = np.nonzero(_distance(fps[rows, None], fps[None, right]) <= radius)
        a, b = rows[a], right[b]
        once = a < b if not part.any() else a != b
        if label is not None:
            once &= label[a] != label[b]
            kept += zip(a[once].tolist(), b[once].tolist(), strict=True)
        else:
            kept += _forest(a[once], b[once], parent)
    return kept


def _shifted(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of equal keys, by comparing each row with the next, the one after, and so on."""
    a, b, at, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(keys)), 1
    while len(at := at[at + d < len(keys)]) and len(at := at[keys[at] == keys[at + d]]):
        hit = at[_distance(fps[at], fps[at + d]) <= radius]
        a.append(hit)
        b.append(hit + d)
        d += 1
    return np.concatenate(a), np.concatenate(b)


def links(fps: DataFrame, radius: int = 3, words: int = 1, blocks: int | None = None, more: int = 0, labelled: bool = False) -> DataFrame:
    """(a, b): links that connect the pairs of distinct ``fp`` within ``radius`` bits of each other.

    ``blocks`` per word is ``radius + 1`` unless given; with fewer blocks in all than that, pairs
    that differ in every block are not found. ``fp`` may have ``more`` words that do not count as bits;
    if ``labelled``, the last of them is a label, and all links between different labels are given.
    """
    tiled = _tiled(fps, radius, words, blocks or radius + 1)
    dealt = tiled.repartition(tasks(fps.sparkSession), "pair").sortWithinPartitions("pair")
    whole = words + more
    kind, arrow = ("bigint", pa.int64()) if whole == 1 else ("array<bigint>", pa.list_(pa.int64()))

    def rows_of(f):
        return pa.array(f[:, 0].view(np.int64)) if whole == 1 else pa.FixedSizeListArray.from_arrays(np.ascontiguousarray(f).view(np.int64).ravel(), whole).cast(arrow)

    def solve(keys, part, f):
        """Runs of at most 32 rows at once, longer ones by their matrix."""
        cuts = np.flatnonzero(np.diff(keys)) + 1
        sizes = np.diff([0, *cuts, len(keys)])
        plain = (np.repeat(sizes, sizes) <= 32) & (np.repeat(np.maximum.reduceat(part, np.r_[0, cuts]), sizes) == 0)
        own = np.flatnonzero(plain)
        bits, label = f[:, :words], f[:, -1] if labelled else None
        a, b = (own[x] for x in _shifted(keys[own], bits[own], radius))
        out = [[a, b] if label is None else [a[label[a] != label[b]], b[label[a] != label[b]]]]
        for start, n in zip(np.r_[0, cuts], sizes, strict=True):
            stretch = slice(start, start + n)
            if not plain[start] and (found := compare(bits[stretch], part[stretch], radius, None if label is None else label[stretch])):
                out.append([start + np.array(x, np.int64) for x in zip(*found, strict=True)])
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([rows_of(f[a]), rows_of(f[b])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            fp = batch.column(2) if whole == 1 else batch.column(2).flatten()
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp.to_numpy().view(np.uint64).reshape(-1, whole)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last pair may go on
            if last:
                yield solve(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held and len(held[0]):
            yield solve(*held)

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _named(prints: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``prints``: the smallest doc_id of the fingerprint's component."""
    grouped = roots.join(classes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    joined = roots.join(grouped, "root").select("node", "component_id")
    named = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id that links reach."""
    prints = written(fingerprints(docs, width, seed), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = written(components(links(classes.select("fp"), radius)), "roots")
    return _named(prints, classes, roots)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, seed: int, similarity: float) -> DataFrame:
    """(a, b, same): whether the shingle sets of each pair have Jaccard ``similarity``; written."""
    nodes = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).distinct()
    rows = classes.join(nodes, "fp").select("text_of.doc_id", "text_of.row", "fp")
    sets = written(shingle_sets(docs, rows, width, seed), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    same = F.coalesce(shared / F.nullif(F.size("x") + F.size("y") - shared, F.lit(0)) >= similarity, F.lit(False))
    return written(both.select("a", "b", same.alias("same")), "verified")


def similar_groups(docs: DataFrame, width: int, similarity: float, words: int, seed: int) -> DataFrame:
    """(doc_id, fp, component_id) of every row, linked where the shingle sets have Jaccard ``similarity``.

    Links within ``radius`` are candidates. A forest of them is verified first. A component whose forest holds is
    connected whatever its other candidates are; in the others every candidate between what is not connected yet
    is verified too. So no candidate that could join two groups is left out, and a group of n
    near copies costs about n checks, not its pairs.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = BITS * words
    radius = int(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    prints = written(set_fingerprints(docs, width, seed, words), "fingerprints")
    one_text = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("text_of")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), one_text), "classes")
    forest = written(links(classes.select("fp"), radius, words, 6, 1).distinct(), "candidates")
    checked = _verified(forest, docs, classes, width, seed, similarity)
    roots = written(components(checked.where("same")), "roots")
    if checked.where("NOT same").limit(1).count():
        reached = written(components(forest), "reached")
        bad = checked.where("NOT same").join(reached, F.col("a") == F.col("node")).select("root").distinct()
        open_nodes = reached.join(bad, "root").select(F.col("node").alias("fp"))
        label = F.xxhash64(F.coalesce("root", "fp"))
        labelled = open_nodes.join(roots, F.col("fp") == F.col("node"), "left").select(F.concat("fp", F.array(label)).alias("fp"))
        pairs = links(written(labelled, "open"), radius, words, 6, 2, True).select(*[F.slice(c, 1, words + 1).alias(c) for c in ("a", "b")])
        others = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        again = _verified(written(others, "candidates"), docs, classes, width, seed, similarity)
        roots = written(components(checked.where("same").unionAll(again.where("same")).select("a", "b")), "roots")
    return _named(prints, classes, roots)


def one_of_each_group(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 8, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group does; all columns stay.

    Two texts are linked if the sets of their shingles have Jaccard ``similarity`` or more, by exact comparison of
    the pairs that fingerprints of ``words`` times 64 bits propose. The document with the smallest id of a
    group stays, with all rows that repeat its id; rows without an id stay only if no member of
    their group has one.
    """

    def first() -> DataFrame:
        groups = similar_groups(docs, width, similarity, words, seed)
        return groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()

    keep = written_alone(docs.sparkSession, first, "first-of-group")
    return docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
