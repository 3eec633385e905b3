"""Hard negatives by cover trees over norm-augmented vectors.

One more component gives all candidates of a tree the same length M, so that a candidate's inner product with an
anchor q is |q| M cos(angle). A tree covers its points level by level: the children of a node are
points further apart than half its radius that cover its points within half its radius. Every node knows how far
its farthest point is, which is an angle around its centre and bounds the inner products of all its
points from both sides. A search takes nodes best first, skips those whose bounds lie outside all
windows that are still open or below the scores already found, and verifies the points of leaves exactly.

Two searches of the same trees make the result: the first ``positives`` rows of an anchor's own label, whose
scores then open one window of scores each, and the first ``negatives`` rows of other labels in each window.

Scale: trees hold at most ``SHARD`` rows and are stored as one row each; anchors come in blocks of
``BLOCK``. A row of the search's input is a tree with a block of anchors: every anchor meets every tree, which is a
stated query set against all rows, and nothing is gathered beyond a tree and a block. A task keeps
its best rows of a block from tree to tree, so later trees are cut by them, and returns only these; a hot label
or a group of copies is spread over the trees like any other rows.

Defined results: rows with a null label, a null vector, or any null or non-finite component take no
part; neither do empty vectors. Vectors of different lengths have no score. A null id belongs to no anchor and stands after
all ids in ties. Rows that repeat an id are rows of their own, each an anchor if the id says so, and
their order is that of the table as read. Scores are exact integers below 2^53 in magnitude (vectors
shorter than 2^26); longer ones are rounded as doubles are and end at the limits of 64 bits. An empty table
gives an empty result. Further columns of any name are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tideline.llm.common import tasks
from tideline.session import written

#: Rows of a tree, and anchors of a block, at most.
SHARD, BLOCK = 4096, 4096
#: Points of a leaf: a node is split while it has more and they are not all equal.
LEAF = 16
#: Leaves that are verified at once, and trees that a task searches for a block.
RUN, TREES = 64, 256
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1
#: Bounds are wider by this share of |q| M than computed, for rounding.
SLACK = 1e-7
TREE = "shard bigint, length int, points binary, uid binary, vec_id binary, label binary, first binary, count binary, child binary, children binary, reach binary, centre binary"


class Tree:
    """Points in the order of the leaves; nodes in order of levels, a node's points and children side by side.

    ``first`` and ``count`` are a node's points, ``child`` and ``children`` its child nodes (none: a leaf),
    ``centre`` a point and ``reach`` the distance of its farthest point in the augmented space.
    """

    def __init__(self, points: np.ndarray):
        square = (points**2).sum(1)
        self.most = float(square.max())
        x = np.column_stack([points, np.sqrt(np.maximum(self.most - square, 0))])
        order, at = np.arange(len(x)), 0
        nodes = [[0, len(x), 0, 0, 0, float(np.sqrt(((x - x[0]) ** 2).sum(1).max()))]]
        while at < len(nodes):
            first, count, _, _, centre, reach = nodes[at]
            if count > LEAF and reach > 0:
                own = order[first : first + count]
                centres, nearest, away = _cover(x, own, centre, reach / 2)
                nodes[at][2:4] = len(nodes), len(centres)
                turn = np.argsort(nearest, kind="stable")
                order[first : first + count] = own[turn]
                ends = np.cumsum(np.bincount(nearest, minlength=len(centres)))
                far = np.maximum.reduceat(away[turn], np.r_[0, ends[:-1]])
                for c, a, b, r in zip(centres, np.r_[0, ends[:-1]], ends, far, strict=True):
                    nodes.append([first + int(a), int(b - a), 0, 0, int(c), float(r)])
            at += 1
        self.order = order
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        first, count, child, children, centre, reach = zip(*nodes, strict=True)
        self.first, self.count, self.child, self.children = (np.array(v, np.int32) for v in (first, count, child, children))
        self.centre, self.reach = place[list(centre)].astype(np.int32), np.array(reach)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * (x @ y.T), 0)


def _cover(x: np.ndarray, own: np.ndarray, centre: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres more than ``radius`` apart that cover the points ``own`` within it, ``centre`` among them.

    Returns the centres, and for each point the place of its nearest centre and the distance from it.
    """
    centres, best, nearest = [], np.full(len(own), np.inf), np.zeros(len(own), np.int64)
    left, next_ = np.arange(len(own)), np.array([centre])
    while len(next_):
        near = _squares(x[next_], x[next_]) <= radius**2
        chosen = []
        for i in range(len(next_)):
            if not near[i, chosen].any():
                chosen.append(i)
        d = _squares(x[own], x[next_[chosen]])
        closest = d.argmin(1)
        d = d[np.arange(len(own)), closest]
        better = d < best
        nearest[better], best[better] = closest[better] + len(centres), d[better]
        centres += next_[chosen].tolist()
        best[np.isin(own, next_[chosen])] = 0.0  # a centre covers itself, whatever the rounding
        left = left[best[left] > radius**2]
        next_ = own[left[:128]]
    used, nearest = np.unique(nearest, return_inverse=True)
    centres = np.array(centres)[used]
    # distances once more by differences, which lose less than squares
    return centres, nearest, np.sqrt(((x[own] - x[centres[nearest]]) ** 2).sum(1)) * (1 + 1e-12)


def trees(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each tree over at most ``shard`` rows of (uid, vec_id, label, x), taken as they come."""

    def run(batches):
        held: dict[int, list] = {}
        at = 0

        def tree(d, parts):
            nonlocal at
            points, uid, vec_id, label = (np.concatenate(v) for v in zip(*parts, strict=True))
            t = Tree(points)
            cells = [points[t.order], uid[t.order], vec_id[t.order], label[t.order], t.first, t.count, t.child, t.children, t.reach, t.centre]
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([int(uid[0])]), pa.array([d], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=[f.split()[0] for f in TREE.split(", ")])

        for b in batches:
            lengths = b.column(3).value_lengths().to_numpy()
            values, starts = b.column(3).flatten().to_numpy(), np.r_[0, np.cumsum(lengths)]
            uid, label = b.column(0).to_numpy(), b.column(2).to_numpy()
            vec_id = b.column(1).fill_null(NO_ID).to_numpy()
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                while len(own):
                    room = shard - sum(len(p[1]) for p in held.get(int(d), []))
                    part, own = own[:room], own[room:]
                    held.setdefault(int(d), []).append((values[starts[part][:, None] + np.arange(d)], uid[part], vec_id[part], label[part]))
                    if len(part) == room:
                        yield tree(int(d), held.pop(int(d)))
        for d, parts in held.items():
            yield tree(d, parts)

    return rows.select("uid", "vec_id", "label", "x").mapInArrow(run, TREE)


class Best:
    """The best rows (score, vec_id, uid, label) of each window of an anchor so far, at most ``k`` each."""

    def __init__(self, windows: int, k: int):
        self.k, self.rows = k, [[np.empty(0)] + [np.empty(0, np.int64)] * 3 for _ in range(windows)]
        self.least = np.full(windows, -np.inf)

    def add(self, w: int, score, vec_id, uid, label) -> None:
        score, vec_id, uid, label = (np.concatenate(v) for v in zip(self.rows[w], (score, vec_id, uid, label), strict=True))
        turn = np.lexsort((uid, vec_id, -score))[: self.k]
        self.rows[w] = [score[turn], vec_id[turn], uid[turn], label[turn]]
        if len(turn) == self.k:
            self.least[w] = score[turn[-1]]


def search(t: dict, q: np.ndarray, low: np.ndarray, high: np.ndarray, fits, best: Best) -> int:
    """Add to ``best`` what tree ``t`` holds for anchor q in each window [low, high]; returns how many points it scored.

    ``fits(label, uid)`` tells which rows may be taken.
    """
    scale = float(np.sqrt(q @ q)) * t["size"]
    slack = SLACK * scale + 1e-9
    scored, serial = 0, 0

    def bounds(start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and most score of the points of some nodes, by the angle around their centres."""
        dot = t["centres"][start:end] @ q
        least, up = dot - slack, dot + slack
        wide = np.flatnonzero(t["turn"][start:end] > 0)
        if len(wide) and scale:
            angle, turn = np.arccos(np.clip(dot[wide] / scale, -1, 1)), t["turn"][start:end][wide]
            least[wide] = scale * np.cos(np.minimum(angle + turn, math.pi)) - slack
            up[wide] = scale * np.cos(np.maximum(angle - turn, 0)) + slack
        return least, up

    def wanted(least: np.ndarray, up: np.ndarray) -> np.ndarray:
        """(node, window): what may still hold something for a window."""
        return (up[:, None] >= np.maximum(low, best.least)) & (least[:, None] <= high)

    def verify(nodes: np.ndarray) -> None:
        nonlocal scored
        places = _ranges(t["first"][nodes], t["count"][nodes])
        places = places[fits(t["label"][places], t["uid"][places])]
        scored += len(places)
        score = t["points"][places] @ q
        for w in range(len(low)):
            good = (score >= max(low[w], best.least[w])) & (score <= high[w])
            if good.any():
                p = places[good]
                best.add(w, score[good], t["vec_id"][p], t["uid"][p], t["label"][p])

    heap = [(-math.inf, 0, np.zeros(1, np.int64), *bounds(0, 1))]
    while heap:
        _, _, nodes, least, up = heapq.heappop(heap)
        nodes = nodes[wanted(least, up).any(1)]
        if not len(nodes):
            continue
        if t["children"][nodes[0]] == 0:  # a run of leaves
            verify(nodes)
            continue
        child = np.arange(t["child"][nodes[0]], t["child"][nodes[0]] + t["children"][nodes[0]])
        least, up = bounds(child[0], child[-1] + 1)
        keep = wanted(least, up)
        # a node stands as high as it reaches in a window that it is wanted for
        rank = np.where(keep, np.minimum(up[:, None], high), -np.inf).max(1)
        some = np.flatnonzero(keep.any(1))
        some = some[np.argsort(-rank[some], kind="stable")]
        leaf = t["children"][child[some]] == 0
        for group, width in ((some[leaf], RUN), (some[~leaf], 1)):
            for s in range(0, len(group), width):
                part, serial = group[s : s + width], serial + 1
                heapq.heappush(heap, (-float(rank[part[0]]), serial, child[part], least[part], up[part]))
    return scored


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of first, first + 1, ... of each pair."""
    first, count = first.astype(np.int64), count.astype(np.int64)
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def opened(row: dict) -> dict:
    """A stored tree as arrays."""
    kinds = {"uid": np.int64, "vec_id": np.int64, "label": np.int64, "first": np.int32, "count": np.int32, "child": np.int32, "children": np.int32}
    t = {"points": np.frombuffer(row["points"], np.float64).reshape(-1, row["length"])} | {c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}
    t["centres"] = t["points"][np.frombuffer(row["centre"], np.int32)]
    t["size"] = math.sqrt(float((t["points"] ** 2).sum(1).max()))
    reach = np.frombuffer(row["reach"], np.float64)
    t["turn"] = 2 * np.arcsin(np.minimum(reach / (2 * t["size"]), 1)) if t["size"] else np.zeros(len(reach))
    return t


def searched(index: DataFrame, anchors: DataFrame, k: int, same: bool, block: int = BLOCK) -> DataFrame:
    """(anchor, window, uid, vec_id, label, score): the first ``k`` rows of each window of each anchor that a task met.

    ``anchors`` has (uid, label, x, low, high), low and high one bound for each window. Rows of the
    anchor's own label count if ``same``, but for itself, else rows of other labels.
    """
    spark = index.sparkSession
    n = tasks(spark)
    blocks = max(1, math.ceil(anchors.count() / block))
    # parts of the trees for each block: as many as keep all tasks busy, and no more trees than a task gets done
    parts = max(1, math.ceil(2 * n / blocks), math.ceil(index.count() / TREES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    one = anchors.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.struct("uid", "label", "x", "low", "high").alias("anchor"))
    two = index.select(every(blocks).alias("block"), F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part"), F.struct(*index.columns).alias("tree"))
    units = one.unionByName(two, allowMissingColumns=True)
    dealt = units.repartition(n, "block", "part").sortWithinPartitions("block", "part", F.col("tree").isNotNull())

    def finish(held):
        out = [(a["uid"], w, int(u), int(i), int(g), max(min(int(s), 2**63 - 1), -(2**63))) for a, best in held for w, rows in enumerate(best.rows) for s, i, u, g in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names=["anchor", "window", "uid", "vec_id", "label", "score"])

    def fits(a):
        if same:
            return lambda label, uid: (label == a["label"]) & (uid != a["uid"])
        return lambda label, uid: label != a["label"]

    def run(batches):
        now, held = None, []
        for b in batches:
            names, anchor, tree = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), b.column(3)
            for i, name in enumerate(names):
                if name != now:
                    if held:
                        yield finish(held)
                    now, held = name, []
                if anchor[i].is_valid:
                    a = anchor[i].as_py()
                    a |= {c: np.array(a[c], np.float64) for c in ("x", "low", "high")}
                    held.append((a, Best(len(a["low"]), k)))
                    continue
                t = opened(tree[i].as_py())
                for a, best in held:
                    if len(a["x"]) == t["points"].shape[1]:
                        search(t, a["x"], a["low"], a["high"], fits(a), best)
        if held:
            yield finish(held)

    return dealt.mapInArrow(run, "anchor bigint, window bigint, uid bigint, vec_id bigint, label bigint, score bigint")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window over all trees, with their ``rank``; each task sent at most as many."""
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("vec_id", F.nullif("vec_id", F.lit(NO_ID)))


def quantised(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """(uid, vec_id, label, x) of the rows that take part, written; x is floor(scale * component) as doubles that end at ±1e100."""
    rows = vectors.select("vec_id", label.cast("bigint").alias("label"), "embedding")
    fine = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda v: F.least(F.greatest(_floor(v.cast("double") * scale), F.lit(-1e100)), F.lit(1e100)))
    taken = rows.where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    return written(taken.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", x.alias("x")), "vectors")


def _floor(v: Column) -> Column:
    """Floor as a double; doubles of 2^53 and more are whole."""
    return F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks.

    ``anchor`` is a condition on vec_id. A negative's score is from ``low`` to ``high`` percent of its positive's score.
    """
    rows = quantised(vectors, F.col("label") if label is None else label, scale)
    index = written(trees(rows, shard), "trees")
    anchors = rows.where(F.coalesce(anchor, F.lit(False)))
    end = F.array(F.lit(float("inf")))
    found = searched(index, anchors.select("uid", "label", "x", F.transform(end, lambda v: -v).alias("low"), end.alias("high")), positives, True, block)
    pairs = written(_first(found, positives).select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda part: F.col("positive_score").cast("decimal(30,0)") * part / 100
    # no score is in the window of a negative one; the place in the arrays is the positive's rank
    bounds = pairs.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", F.ceil(share(low)).cast("double").alias("low"), F.floor(share(high)).cast("double").alias("high")))).alias("b"))
    windows = anchors.join(bounds, F.col("uid") == F.col("anchor")).select("uid", "label", "x", F.col("b.low").alias("low"), F.col("b.high").alias("high"), "vec_id")
    windows = written(windows, "windows")
    best = _first(searched(index, windows.drop("vec_id"), negatives, False, block), negatives)
    named = best.join(pairs.withColumn("window", F.col("rank") - 1).drop("rank"), ["anchor", "window"]).join(windows.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
