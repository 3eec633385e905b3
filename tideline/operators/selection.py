"""Correlation, F-score and mutual-information feature selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.nulls import INF, correlation, ratio
from tideline.session import written


def _complete(a: str, b: str) -> tuple[Column, Column]:
    """Both values, or NULL for both when one is missing."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(ok, F.col(a)), F.when(ok, F.col(b))


def pair_corr(a: str, b: str) -> Column:
    return correlation(F.col(a), F.col(b))


def _unstack(row: DataFrame, items: dict[str, list[Column]], names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    cols = [F.struct(*[c.alias(n) for n, c in zip(names, cs)]) for cs in items.values()]
    return row.select(*keys, F.explode(F.array(*cols)).alias("r")).select(*keys, *[f"r.{n}" for n in names])


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, on rows where both are present.

    Columns are centred first (their means are one broadcast row), each partition adds up
    its sums of products as small matrices, and one row per pair and partition is shuffled.
    The work per batch is a few matrix products, not one expression per pair, which took twice
    the time already for ten columns.
    """
    columns = list(columns)
    means = df.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)])
    centred = df.select(*columns).crossJoin(F.broadcast(means)).select(  # one row
        *[(F.col(c).cast("double") - F.col(f"__m{i}")).alias(f"x{i}") for i, c in enumerate(columns)]
    )
    n = len(columns)
    left, right = np.triu_indices(n, 1)

    def add_up(batches):
        sums = np.zeros((4, n, n))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            seen = ~np.isnan(x)
            m, x = seen.astype(float), np.where(seen, x, 0.0)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        count, total, square, product = sums
        yield pd.DataFrame(
            {
                "i": left, "j": right, "n": count[left, right], "sx": total[left, right], "sy": total[right, left],
                "sxx": square[left, right], "syy": square[right, left], "sxy": product[left, right],
            }
        )

    figures = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    part = centred.mapInPandas(add_up, "i int, j int, " + ", ".join(f"{f} double" for f in figures))
    t = part.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in figures])
    c = F.col
    cov = c("sxy") - ratio(c("sx") * c("sy"), c("n"))
    spread = (c("sxx") - ratio(c("sx") * c("sx"), c("n"))) * (c("syy") - ratio(c("sy") * c("sy"), c("n")))
    names = F.array(*[F.lit(x) for x in columns])
    r = F.when(spread > 0, ratio(cov, F.sqrt(spread)))
    return t.select(F.element_at(names, c("i") + 1).alias("left_column"), F.element_at(names, c("j") + 1).alias("right_column"), r.alias("r"))


def high_corr_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    return matrix.where(F.abs("r") > threshold)


def target_corr(df: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """|r| of every column with the target."""
    cols = [c for c in columns if c != target]
    row = df.groupBy(*keys).agg(*[pair_corr(c, target).alias(f"__{i}") for i, c in enumerate(cols)])
    items = {c: [F.lit(c), F.abs(F.col(f"__{i}"))] for i, c in enumerate(cols)}
    return _unstack(row, items, ["feature", "abs_r"], keys)


def f_score(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """r^2 / (1 - r^2) * (n - 2) on rows where both are present."""
    cols = [c for c in columns if c != target]
    aggs = []
    for i, c in enumerate(cols):
        a, _ = _complete(c, target)
        aggs += [pair_corr(c, target).alias(f"__r{i}"), F.count(a).alias(f"__n{i}")]
    row = df.agg(*aggs)
    items = {}
    for i, c in enumerate(cols):
        r2 = F.col(f"__r{i}") * F.col(f"__r{i}")
        items[c] = [F.lit(c), F.abs(F.col(f"__r{i}")), ratio(r2, 1 - r2) * (F.col(f"__n{i}") - 2)]
    return _unstack(row, items, ["feature", "abs_r", "f"])


def binned_mutual_info(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Mutual information in nats between the binned target and each binned column.

    Columns hold bin numbers (see ``quantile_bins``). One contingency count over all columns,
    combined on the map side: at most features * bins^2 rows are shuffled per partition. The counts are written once.
    """
    cols = [c for c in columns if c != target]
    long = df.unpivot([target], cols, "feature", "x").where(F.col("x").isNotNull() & F.col(target).isNotNull())
    joint = long.groupBy("feature", "x", F.col(target).alias("y")).agg(F.count("*").cast("double").alias("n"))
    joint = written(joint, "contingency")  # read four times
    nx = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ny = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    tot = joint.groupBy("feature").agg(F.sum("n").alias("t"))
    p = joint.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(tot, "feature")
    term = F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    return p.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Bin numbers by exact quantiles: how many of the different cut points a value reaches; NULL stays NULL.

    The cut points, ``bins - 1`` numbers a column, are collected; rows are binned in Arrow batches, where a search among
    sorted numbers takes a fraction of what a function on arrays takes row by row.
    """
    from tideline.operators.ordered import exact_quantiles

    long = df.unpivot([], list(columns), "__column", "__value")
    cuts: dict[str, list[float]] = {c: [] for c in columns}
    for r in exact_quantiles(long, ["__column"], "__value", [i / bins for i in range(1, bins)], few_keys=True).collect():
        cuts[r["__column"]].append(r["quantile"])
    sorted_cuts = {c: np.unique(q) for c, q in cuts.items()}

    def run(batches):
        for b in batches:
            out = []
            for name, x in zip(b.schema.names, b.columns, strict=True):
                if name in sorted_cuts:
                    missing = x.is_null().to_numpy(zero_copy_only=False)
                    reached = np.searchsorted(sorted_cuts[name], x.cast(pa.float64()).to_numpy(zero_copy_only=False), side="right")
                    x = pa.array(reached.astype(np.int32), mask=missing)
                out.append(x)
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    fields = [T.StructField(f.name, T.IntegerType()) if f.name in sorted_cuts else f for f in df.schema.fields]
    return df.mapInArrow(run, T.StructType(fields))


def combined_score(scores: DataFrame, mi: DataFrame) -> DataFrame:
    """Mean of |r|, mutual information and F over the largest F (one row per feature)."""
    top = scores.agg(F.max("f").alias("__top"))
    d = scores.join(mi, "feature", "left").crossJoin(F.broadcast(top))  # one row
    score = (F.coalesce("abs_r", F.lit(0.0)) + F.coalesce("mi", F.lit(0.0)) + F.coalesce(ratio(F.col("f"), F.col("__top")), F.lit(0.0))) / 3
    return d.select("feature", "abs_r", "mi", "f", score.alias("score"))


def drop_collinear(strength: DataFrame, matrix: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Rows of ``strength`` (feature, abs_r) that the greedy rule keeps: strongest first, a feature stays
    unless it correlates beyond the threshold with one kept before. Equal strength goes by name.

    ``matrix`` is that of ``corr_matrix``. The rule is a fold over one row, whose size is the number of
    columns and of pairs beyond the threshold, so the selection is a part of the caller's plan.
    """
    beyond = matrix.where(F.abs("r") > threshold)
    both = beyond.select(F.col("left_column").alias("feature"), F.col("right_column").alias("other"))
    both = both.unionAll(beyond.select(F.col("right_column").alias("feature"), F.col("left_column").alias("other")))
    clashes = both.groupBy("feature").agg(F.collect_set("other").alias("others"))
    ranked = strength.select("feature", F.coalesce("abs_r", F.lit(0.0)).alias("abs_r")).join(clashes, "feature", "left")
    item = F.struct((-F.col("abs_r")).alias("weak"), "feature", F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    keep = lambda kept, f: F.when(F.arrays_overlap(kept, f["others"]), kept).otherwise(F.array_append(kept, f["feature"]))
    names = ranked.agg(F.aggregate(F.sort_array(F.collect_list(item)), F.array().cast("array<string>"), keep).alias("kept"))
    return strength.join(names.select(F.explode("kept").alias("feature")), "feature", "left_semi")


def fit_select(df: DataFrame, columns: Sequence[str], target: str, k: int = 20, threshold: float = 0.9, bins: int = 10) -> DataFrame:
    """Selected features with their scores: collinear ones out, then the k best by mean score.

    One plan: everything over rows is an aggregate, and which features stay is a small table that the
    scores are joined with. The complete rows are read several times, so they are written once.
    """
    columns = [c for c in columns if c != target]
    complete = written(df.select(*columns, target).na.drop(), "complete-rows")
    f = f_score(complete, columns, target)
    kept = drop_collinear(f.select("feature", "abs_r"), corr_matrix(complete, columns), threshold).select("feature")
    mi = binned_mutual_info(quantile_bins(complete, [*columns, target], bins), columns, target)
    scores = combined_score(f.join(kept, "feature", "left_semi"), mi.join(kept, "feature", "left_semi"))
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def selector_transform(df: DataFrame, selected: Sequence[str], keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """Keys, time, OHLCV, then the selected features."""
    lead = [*keys, "ts", "timestamp", "datetime", "open", "high", "low", "close", "volume"]
    return df.select(*[c for c in lead if c in df.columns], *[c for c in selected if c in df.columns and c not in lead])


def source_counts(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Features and present values per source, from an explicit ``{column: source}`` map.

    Columns without an entry are price features.
    """
    row = df.agg(*[F.count(c).alias(f"__{i}") for i, c in enumerate(df.columns)])
    items = {c: [F.lit(c), F.lit(roles.get(c, "price")), F.col(f"__{i}")] for i, c in enumerate(df.columns)}
    long = _unstack(row, items, ["feature", "source", "n"])
    return long.groupBy("source").agg(F.count("*").alias("n_features"), F.sum("n").alias("n_values"))


def source_impact(correlations: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Mean |r| of external and price features and their ratio, from (feature, abs_r)."""
    is_ext = F.col("feature").isin([c for c, s in roles.items() if s != "price"])
    ext, price = F.avg(F.when(is_ext, F.col("abs_r"))), F.avg(F.when(~is_ext, F.col("abs_r")))
    return correlations.agg(
        F.count(F.when(is_ext, 1)).alias("n_external"), F.count(F.when(~is_ext, 1)).alias("n_price"),
        ext.alias("external_abs_r"), price.alias("price_abs_r"), ratio(ext, price).alias("impact_ratio"),
    )
