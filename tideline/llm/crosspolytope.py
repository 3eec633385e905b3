"""Near-duplicate vectors by cross-polytope hashing.

A hash turns a vector with three rounds of random signs and a fast Hadamard transform and names the
axis and sign of the largest coordinate: the nearest corner of a cross-polytope. A table joins several
hashes to one key. Every vector lives under its own key of a table and also visits the next best
corners (multiprobe); a pair is compared if one of the two lives where the other lives or visits. Candidates
are verified by their cosine in double precision, so no pair below the threshold is ever linked.

Sizes follow from the input alone: as many hashes a key as leave about ``STRANGERS`` unrelated
vectors under it, and as many tables as find a pair exactly at the threshold with probability
``recall`` (estimated on random pairs at that cosine; pairs above it are found more often).

Scale: equal vectors are one class before anything is hashed. A key with more than ``TILE``
vectors is cut into tiles that meet pair by pair in separate tasks, so no group is gathered; what a tile
returns is one count for each vector and a spanning forest of its links, never the links themselves. A pair that
several keys bring together is counted under the first of them only.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, link with
nothing and form a component of their own row. Vectors of different lengths are never linked. Rows that
repeat a vector or an id are rows of their own: they count as links of each other and share a component. A
component's id is its smallest id that is not null; it is null only if none of its rows has one, and then its
rows count as kept. An empty table gives an empty result. Further columns of any name are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import salted_lookup, tasks
from tideline.llm.components import components
from tideline.session import written

#: Unrelated vectors that share a key on average, at most.
STRANGERS = 8
#: Corners besides its own that a vector visits in each table.
PROBES = 2
#: Corners of one hash that probes choose from.
CORNERS = 3
#: Tables at most, unless one hash a key needs more.
MOST_TABLES = 64
#: Vectors of one side of a tile pair.
TILE = 2048
#: Cosines this near the threshold are summed again without rounding.
NEAR = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def _corners(x: np.ndarray, table: int, at: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest corners of one hash for each row, best first, and what each loses against the best."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([seed, x.shape[1], table, at]).choice([-1.0, 1.0], size=(3, size))
    y = np.zeros((len(x), size))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    far = np.abs(y)
    top = np.argsort(-far, axis=1, kind="stable")[:, :CORNERS]
    height = np.take_along_axis(far, top, 1)
    return 2 * top + (np.take_along_axis(y, top, 1) < 0), (height[:, :1] - height) ** 2


def keys_of(x: np.ndarray, hashes: int, tables: int, probes: int = PROBES, seed: int = 42) -> np.ndarray:
    """(row, table, 1 + probes) keys of unit vectors: a row's own key first, then the keys it visits."""
    out = []
    for t in range(tables):
        best, loss = zip(*(_corners(x, t, k, seed) for k in range(hashes)), strict=True)
        combos = np.stack(np.meshgrid(*[np.arange(b.shape[1]) for b in best], indexing="ij"), -1).reshape(-1, hashes)
        total = sum(loss[k][:, combos[:, k]] for k in range(hashes))
        chosen = combos[np.argsort(total, axis=1, kind="stable")[:, : 1 + probes]]
        # codes are below 2 * length; the mixed number is a key's name, and two keys that meet by it only cost comparisons
        key = np.full(chosen.shape[:2], (t + 1) * 0x9E3779B97F4A7C15 + x.shape[1] & (1 << 64) - 1, np.uint64)
        for k in range(hashes):
            key = (key ^ np.take_along_axis(best[k], chosen[:, :, k], 1).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        if key.shape[1] < 1 + probes:  # fewer corners than probes: a key where nothing lives
            key = np.concatenate([key, np.full((len(x), 1 + probes - key.shape[1]), t + 1, np.uint64)], 1)
        out.append(key)
    return np.stack(out, 1).view(np.int64)


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, table): whether the first of a pair lives at a key of the second, and the other way round."""
    return (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)


@functools.lru_cache(maxsize=256)
def sizes(rows: int, length: int, cosine: float, recall: float, seed: int = 42) -> tuple[int, int]:
    """(hashes, tables) for so many vectors of one length; short vectors get fewer hashes where more would need over ``MOST_TABLES``."""
    corners = 2 << max(0, length - 1).bit_length()
    hashes = max(1, math.ceil(math.log(max(rows / STRANGERS, 1)) / math.log(corners)))
    rng = np.random.default_rng([seed, length])
    a, other = rng.normal(size=(2, 2000, length))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other -= (other * a).sum(1, keepdims=True) * a
    size = np.linalg.norm(other, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine**2)) * np.divide(other, size, out=np.zeros_like(other), where=size > 1e-9)
    while True:
        there, back = _meet(keys_of(a, hashes, 2, seed=seed + 1), keys_of(b, hashes, 2, seed=seed + 1))
        found = min(max((there | back).mean(), 1e-3), 1 - 1e-9)
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))
        if hashes == 1 or tables <= MOST_TABLES:
            return hashes, tables
        hashes -= 1


def _vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def hashed(classes: DataFrame, rows: int, cosine: float, recall: float, seed: int = 42) -> DataFrame:
    """(node, n, vector, keys) of classes (node, n, vector); keys holds 1 + PROBES keys of each table in turn."""

    def run(batches):
        for b in batches:
            values, at = _vectors(b.column(2))
            length, keys = np.diff(at), [None] * b.num_rows
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                for part in np.array_split(own, -(-len(own) // 1024)):
                    x = values[at[part][:, None] + np.arange(d)]
                    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large components would overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for i, k in zip(part, keys_of(x, *sizes(rows, int(d), cosine, recall, seed), seed=seed), strict=True):
                        keys[i] = k.ravel()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["node", "n", "vector", "keys"])

    return classes.select("node", "n", "vector").mapInArrow(run, f"node bigint, n bigint, vector {classes.schema['vector'].dataType.simpleString()}, keys array<bigint>")


def tiled(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(pair, part, key, lives, node, n, vector, keys): what meets in each tile pair; part tells its two sides, or 0 for one tile alone."""
    rows = prints.select("node", F.posexplode("keys").alias("at", "key")).withColumn("lives", F.col("at") % (1 + PROBES) == 0).drop("at")
    # a key that nobody lives at, or one vector alone, makes no pair
    counts = rows.groupBy("key").agg(F.count("*").alias("total"), F.max("lives").alias("lived")).where("lived AND total > 1")
    known = salted_lookup(rows, counts.select("key", F.ceil(F.col("total") / tile).cast("int").alias("tiles"), "total"), "key", "total", F.xxhash64("node"))
    cut = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    dealt = known.withColumn("cut", cut).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    part = F.when(F.col("cut") == F.col("other"), 0).when(F.col("cut") < F.col("other"), 1).otherwise(2)
    slim = dealt.select(F.xxhash64("key", F.least("cut", "other"), F.greatest("cut", "other")).alias("pair"), part.alias("part"), "key", "lives", "node")
    return slim.join(prints, "node")  # only now the vectors move


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine from sums without rounding between."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    dot, a, b = (math.fsum((p * q).tolist()) for p, q in ((x, y), (x, x), (y, y)))
    return dot / math.sqrt(a * b)


def _checked(found: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs (a, b) with cosines ``found`` reach the threshold."""
    hit = found >= cosine
    for i in np.flatnonzero(np.abs(found - cosine) < NEAR):
        hit[i] = _exact(x[a[i]], x[b[i]]) >= cosine
    return hit


def _first(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first at which the pairs with keys a and b (pair, table, probe) meet."""
    there, back = _meet(a, b)
    table = np.argmax(there | back, axis=1)
    i = np.arange(len(key))
    one, two = a[i, table, 0], b[i, table, 0]
    least = np.where(there[i, table] & back[i, table], np.minimum(one, two), np.where(there[i, table], one, two))
    return least == key


def pairs_within(x: np.ndarray, runs: np.ndarray, part: np.ndarray, cosine: float):
    """Yield (a, b) arrays of pairs of rows at the threshold within runs of equal ``runs``, and across their sides where part is not 0."""
    unit = _unit(x)
    cuts = np.r_[0, np.flatnonzero(np.diff(runs)) + 1, len(runs)]
    size = np.diff(cuts)
    short = np.repeat((size <= 32) & (np.maximum.reduceat(part, cuts[:-1]) == 0), size)
    at, d = np.flatnonzero(short), 1
    while len(at := at[at + d < len(runs)]) and len(at := at[runs[at] == runs[at + d]]):
        hit = _checked(np.einsum("ij,ij->i", unit[at], unit[at + d]), at, at + d, x, cosine)
        yield at[hit], at[hit] + d
        d += 1
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if short[start]:
            continue
        left, right = (start + np.flatnonzero(part[start:end] != other) for other in (2, 1))
        alone = not part[start:end].any()
        for rows in np.array_split(left, -(-len(left) // 256)) if len(left) and len(right) else ():
            score = unit[rows] @ unit[right].T
            i, j = np.nonzero(score >= cosine - NEAR)
            a, b, score = rows[i], right[j], score[i, j]
            once = a < b if alone else a != b
            a, b = a[once], b[once]
            hit = _checked(score[once], a, b, x, cosine)
            yield a[hit], b[hit]


def linked(tiles: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): how many links (of rows) each tile found for node a, with b null; and links (a, b) that connect what it connects, with n null."""
    dealt = tiles.repartition(tasks(tiles.sparkSession), "pair").sortWithinPartitions("pair")

    def solve(t: pa.Table) -> pa.RecordBatch:
        pair, part, key, lives, node, n = (t.column(c).to_numpy() for c in ("pair", "part", "key", "lives", "node", "n"))
        values, at = _vectors(t.column("vector"))
        names, name_at = _vectors_of_keys(t.column("keys"))
        length, total, edges = np.diff(at), np.zeros(len(pair), np.int64), []
        for d in np.unique(length):  # vectors of two lengths meet only if their keys' names do
            own = np.flatnonzero(length == d)
            x = values[at[own][:, None] + np.arange(d)]
            k = names[name_at[own][:, None] + np.arange(name_at[own[0] + 1] - name_at[own[0]])].reshape(len(own), -1, 1 + PROBES)
            parent = np.arange(len(own))
            for a, b in pairs_within(x, pair[own], part[own], cosine):
                good = (lives[own[a]] | lives[own[b]]) & (key[own[a]] == key[own[b]]) & (node[own[a]] != node[own[b]])
                a, b = a[good], b[good]
                edges += _forest(a, b, parent, node[own])
                for s in range(0, len(a), 50_000):
                    p, q = a[s : s + 50_000], b[s : s + 50_000]
                    new = _first(key[own[p]], k[p], k[q])
                    np.add.at(total, own[p[new]], n[own[q[new]]])
                    np.add.at(total, own[q[new]], n[own[p[new]]])
        some = np.flatnonzero(total)
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[node[some], a]), pa.concat_arrays([none[0], pa.array(np.ascontiguousarray(b))]), pa.concat_arrays([pa.array(total[some]), none[1]])], names=["a", "b", "n"]
        )

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            pair = held.column("pair").to_numpy()
            last = int(np.argmax(pair == pair[-1]))  # the last pair may go on in the next batch
            if last:
                yield solve(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield solve(held)

    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def _vectors_of_keys(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """Nodes of the links among (a, b) that join two trees of ``parent``, which is updated.

    Links whose ends already hang together are left out in bulk, so the loop meets each vector about once.
    """
    kept = []
    for s in range(0, len(a), 4096):
        p, q = a[s : s + 4096], b[s : s + 4096]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        for x, y in zip(*(v[parent[p] != parent[q]].tolist() for v in (p, q)), strict=True):
            i, j = x, y
            while parent[i] != i:
                i = parent[i]
            while parent[j] != j:
                j = parent[j]
            if i != j:
                parent[max(i, j)] = min(i, j)
                kept.append((node[x], node[y]))
    return kept


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.995, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``, which needs vec_id and embedding."""
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # rows that are compared, one class for each vector; monotonic ids are stored, so that they never change
    classes = rows.where(usable).groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    prints = written(hashed(classes, classes.count(), cosine, recall, seed), "prints")
    found = written(linked(tiled(prints, tile), cosine), "links")
    roots = written(components(found.where("b IS NOT NULL").select("a", "b")), "roots")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    grouped = classes.select("node", "least").join(roots, "node").groupBy("root").agg(F.min("least").alias("component"))
    results = (
        classes.join(counts, "node", "left").join(roots.join(grouped, "root").select("node", "component"), "node", "left")
        .select("vector", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    named = salted_lookup(rows.where(usable), results, "vector", "n", F.xxhash64("vec_id"))
    return named.select("vec_id", "n_links", "component_id").unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
