"""Isolation forest on Spark: trees from small samples, scores for every row."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.ordered import exact_quantiles
from tideline.session import written


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng, nodes: list) -> int:
    """Append the nodes of a random tree over x; a node is (column, cut, left, right, depth)."""
    me = len(nodes)
    nodes.append(None)
    spread = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
    usable = np.flatnonzero(spread > 0)
    if depth >= limit or len(x) <= 1 or not len(usable):
        nodes[me] = (-1, 0.0, 0, 0, depth + _path_length(len(x)))
        return me
    col = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, col].min(), x[:, col].max()))
    left = x[:, col] < cut
    a = _grow(x[left], depth + 1, limit, rng, nodes)
    b = _grow(x[~left], depth + 1, limit, rng, nodes)
    nodes[me] = (col, cut, a, b, 0.0)
    return me


#: Rows that walk down the trees at once, so that their places stay in the processor's cache.
_WALKERS = 4096


class _Forest:
    """Trees as arrays in which each step down is a few gathers over all rows: a leaf leads to itself."""

    def __init__(self, trees: list[pd.DataFrame]):
        self.trees = []
        for t in trees:
            col, me = t["col"].to_numpy(), np.arange(len(t))
            inner = col >= 0
            # the right child is at 2 * node + 1 and the left one at 2 * node of ``down``
            down = np.column_stack([np.where(inner, t["left"], me), np.where(inner, t["right"], me)]).ravel()
            self.trees.append((np.where(inner, col, 0).astype(np.intp), t["cut"].to_numpy(), down.astype(np.intp), t["depth"].to_numpy(), self._levels(t)))

    @staticmethod
    def _levels(t: pd.DataFrame) -> int:
        """Steps from the root to the deepest leaf; children stand after their parents."""
        level = np.zeros(len(t), int)
        for node, (col, left, right) in enumerate(zip(t["col"], t["left"], t["right"], strict=True)):
            if col >= 0:
                level[left] = level[right] = level[node] + 1
        return int(level.max(initial=0))

    def mean_depths(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the depth at which each row of x ends."""
        out = np.zeros(len(x))
        width = x.shape[1]
        for lo in range(0, len(x), _WALKERS):
            part = np.ascontiguousarray(x[lo : lo + _WALKERS])
            flat, first = part.ravel(), np.arange(len(part)) * width
            sums = np.zeros(len(part))
            for col, cut, down, depth, levels in self.trees:
                at = np.zeros(len(part), np.intp)
                for _ in range(levels):
                    right = ~(flat.take(first + col.take(at)) < cut.take(at))
                    at = down.take(2 * at + right)
                sums += depth.take(at)
            out[lo : lo + len(part)] = sums
        return out / max(len(self.trees), 1)


def isolation_flag(df: DataFrame, columns: Sequence[str], ids: Sequence[str], trees: int = 100, sample: int = 256,
                   contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``anomaly_score`` and ``is_outlier`` (the share ``contamination`` with the highest score).

    ``trees`` and ``sample``, the rows a tree is grown from, are parameters of the algorithm. Hashes
    of the ids deal all rows to trees and slots of a tree, and the row with the smallest hash takes
    the slot: one hash aggregate, combined on the map side, whose rows (one a slot) are then looked up. The input is
    written once, as the lookup and the scores read it again. The trees (at most 2 * sample nodes each) are
    broadcast; every row is scored. NULL counts as 0.
    """
    spark = df.sparkSession
    values = written(df, "rows").withColumns({f"__x{i}": F.coalesce(c, F.lit(0.0)).cast("double") for i, c in enumerate(columns)})
    xs = [f"__x{i}" for i in range(len(columns))]
    seeded = lambda k: F.xxhash64(F.lit(seed + k), *ids)
    place = {"tree": F.pmod(seeded(1), F.lit(trees)).cast("int"), "__slot": F.pmod(seeded(2), F.lit(sample)).cast("int")}
    dealt = values.select(*xs, seeded(0).alias("__h"), *[c.alias(n) for n, c in place.items()])
    least = dealt.groupBy("tree", "__slot").agg(F.min("__h").alias("__h"))  # a struct here would sort all rows
    drawn = dealt.join(F.broadcast(least), ["tree", "__slot", "__h"])  # trees * sample rows
    drawn = drawn.groupBy("tree", "__slot").agg(F.min(F.struct("__h", *xs)).alias("r")).select("tree", "r.*")
    limit = math.ceil(math.log2(sample))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("__h")[xs].to_numpy()
        nodes: list = []
        _grow(x, 0, limit, np.random.default_rng(seed + int(pdf["tree"].iloc[0])), nodes)
        out = pd.DataFrame(nodes, columns=["col", "cut", "left", "right", "depth"])
        return out.assign(tree=int(pdf["tree"].iloc[0]), node=range(len(out)), rows=len(x))

    schema = "col int, cut double, left int, right int, depth double, tree int, node int, rows int"
    forest = drawn.groupBy("tree").applyInPandas(build, schema).toPandas()  # <= trees * 2 * sample rows
    grown = [t.sort_values("node").reset_index(drop=True) for _, t in forest.groupby("tree")]
    shared = spark.sparkContext.broadcast(_Forest(grown))
    norm = _path_length(float(np.mean([t["rows"].iloc[0] for t in grown]))) if grown else 1.0

    @F.pandas_udf(T.DoubleType())
    def score(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy() for p in parts])
        return pd.Series(np.round(2.0 ** (-shared.value.mean_depths(x) / max(norm, 1e-12)), 9))

    scored = written(values.withColumn("anomaly_score", score(*xs)).drop(*xs), "scored")  # read by every pass over the scores
    cut = exact_quantiles(scored, [], "anomaly_score", [1 - contamination]).select(F.col("quantile").alias("__cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn(  # one row
        "is_outlier", F.when(F.col("anomaly_score") > F.col("__cut"), 1).otherwise(0)
    ).drop("__cut")
