"""Scored quality checks, profiles, drift and the report of a bar table, per series.

``measure`` gathers every figure the checks need in three steps: a lag projection in arrival
order, exact quartiles per series, one wide conditional aggregate. The checks are then
expressions over one row per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.nulls import INF, correlation, ratio
from tideline.functions.rolling import series_window, so_far
from tideline.operators.bars import PRICES

KEYS = ("series_key",)
NUMERIC = [*PRICES, "volume"]

# Thresholds of the checks and weights of the overall score.
MAX_MISSING, MAX_PRICE_CHANGE, MAX_VOLUME_SPIKE, MAX_GAP_HOURS, MIN_CORRELATION = 0.05, 0.5, 10.0, 24.0, 0.01
WEIGHTS = {"Data Completeness": 0.3, "Data Consistency": 0.25, "Price Integrity": 0.25, "Temporal Integrity": 0.2}
OTHER_WEIGHT = 0.1
ADVICE = {
    "Data Completeness": "fill missing values with a stronger imputation",
    "Data Consistency": "review collection and preprocessing for inconsistent rows",
    "Price Integrity": "validate prices on arrival and flag anomalies",
    "Temporal Integrity": "monitor freshness and alert on gaps",
}


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def adjusted_skew(x: Column) -> Column:
    """Bias-corrected G1 (needs three values)."""
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-corrected excess G2 (needs four values)."""
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def _quantile(ordered: Column, p: float) -> Column:
    """Quantile of an ordered array, as ``low + (high - low) * share``.

    ``percentile`` weighs both neighbours instead, whose last bits can put a value that lies on a fence beyond it.
    """
    at = (F.size(ordered) - 1) * F.lit(p)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))


def _padded_change(x: str, w) -> Column:
    return F.last(x, ignorenulls=True).over(so_far(w))


def measure(df: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq", external: Sequence[str] = ()) -> DataFrame:
    """One row of figures per series; rows arrive in the order of ``seq``."""
    keys = list(keys)
    w = series_window(keys, [seq])
    rows = df.withColumns({f"_pad_{c}": _padded_change(c, w) for c in NUMERIC} | {"_before": F.lag("ts").over(w)})
    rows = rows.withColumns(
        {f"_chg_{c}": F.abs(ratio(F.col(f"_pad_{c}"), F.lag(f"_pad_{c}").over(w)) - 1) for c in NUMERIC}
    )
    ordered = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_v_{c}") for c in NUMERIC])
    quartiles = ordered.select(
        *keys, *[F.array(*[_quantile(F.col(f"_v_{c}"), p) for p in (0.25, 0.75)]).alias(f"_q_{c}") for c in PRICES],
        _quantile(F.col("_v_volume"), 0.5).alias("_median"),
    )
    # distinct times by grouping: a distinct count beside other aggregates would expand every row
    times = df.groupBy(*keys, "ts").agg(F.count("*").alias("_m")).groupBy(*keys).agg(F.count("*").alias("_times"))
    quartiles = quartiles.join(times, keys)
    gap = (F.unix_timestamp("ts") - F.unix_timestamp("_before")).cast("double")
    months = F.months_between("ts", "_before")
    aggs = {
        "n": F.count("*"),
        "n_distinct_ts": F.max("_times"),
        "negative_volume": _n(F.col("volume") < 0),
        "volume_spikes": _n(F.col("_chg_volume") > MAX_VOLUME_SPIKE),
        "low_volume": _n(F.col("volume") < F.col("_median") * 0.01),
        "volume_cv": F.coalesce(F.when(F.avg("volume") > 0, F.stddev_samp("volume") / F.avg("volume")), F.lit(0.0)),
        "max_gap_hours": F.max(gap) / 3600,
        "large_gaps": _n(gap > MAX_GAP_HOURS * 3600),
        "unordered": _n(gap < 0),
        "n_steps": F.count(gap),
        "one_step": F.coalesce((F.min(gap) == F.max(gap)).cast("int"), F.lit(0)),
        "one_month_step": F.coalesce((F.min(months) == F.max(months)).cast("int"), F.lit(0)),
        "whole_months": _n(months == F.floor(months)),
        "shortest_step": F.min(gap),
        "first_ts": F.min("ts"), "last_ts": F.max("ts"),
        "high_violations": _n(F.col("high") < F.greatest("open", "close")),
        "low_violations": _n(F.col("low") > F.least("open", "close")),
        "high_low_violations": _n(F.col("high") < F.col("low")),
    }
    for c in PRICES:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        aggs[f"jumps_{c}"] = _n(F.col(f"_chg_{c}") > MAX_PRICE_CHANGE)
        aggs[f"outliers_{c}"] = _n((F.col(c) < q1 - 3 * (q3 - q1)) | (F.col(c) > q3 + 3 * (q3 - q1)))
        aggs[f"not_positive_{c}"] = _n(F.col(c) <= 0)
    for c in [*NUMERIC, *external]:
        aggs[f"missing_{c}"] = _n(F.col(c).isNull())
    for c in NUMERIC:
        finite = F.when(F.abs(F.col(c)) != INF, F.col(c))
        aggs[f"constant_{c}"] = F.coalesce((F.min(c) == F.max(c)).cast("int"), F.lit(0))
        aggs[f"infinite_{c}"] = _n(F.abs(F.col(c)) == INF)
        aggs[f"skew_{c}"] = adjusted_skew(finite)
    for c in external:
        aggs[f"corr_{c}"] = F.abs(correlation(F.col(c), F.col("close")))
    return rows.join(quartiles, keys).groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])


def _scored(name: str, issues: list[tuple[Column, float | Column, Column]], warn_above: float = 0.5) -> Column:
    """Result struct of a check: each issue is (present, penalty, message)."""
    found = [F.coalesce(cond, F.lit(False)) for cond, _, _ in issues]
    penalty = sum((F.when(f, F.lit(p)).otherwise(0.0) for f, (_, p, _) in zip(found, issues)), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.round(1 - penalty, 9))
    messages = F.filter(F.array(*[F.when(f, m) for f, (_, _, m) in zip(found, issues)]), lambda m: m.isNotNull()) if issues else F.array().cast("array<string>")
    passed = F.size(messages) == 0
    return _result(name, passed, score, F.concat_ws("; ", messages), warn_above)


def _result(name: str, passed: Column, score: Column, message: Column, warn_above: float = 0.5) -> Column:
    severity = F.when(passed, "info").when(score > warn_above, "warning").otherwise("error")
    return F.struct(
        F.lit(name).alias("check_name"), passed.alias("passed"), score.alias("score"),
        severity.alias("severity"), message.alias("message"),
    )


def _say(count: Column, text: str) -> Column:
    return F.concat_ws(" ", count.cast("string"), F.lit(text))


def check_columns(external: Sequence[str] = ()) -> dict[str, Column]:
    """Result of every check as an expression over ``measure``."""
    c = F.col
    cells = c("n") * (1 + len(NUMERIC) + len(external))
    missing = sum(c(f"missing_{x}") for x in [*NUMERIC, *external])
    share = ratio(missing.cast("double"), cells.cast("double"))
    complete = share <= MAX_MISSING
    severity = F.when(complete, "info").when(share < 0.1, "warning").otherwise("error")
    completeness = F.struct(
        F.lit("Data Completeness").alias("check_name"), complete.alias("passed"),
        F.greatest(F.lit(0.0), 1 - share / MAX_MISSING).alias("score"), severity.alias("severity"),
        F.concat_ws(" ", F.lit("missing ratio"), F.round(share, 3).cast("string")).alias("message"),
    )
    consistency = [
        (c("n") > c("n_distinct_ts"), 0.3, _say(c("n") - c("n_distinct_ts"), "duplicate timestamps")),
        (c("negative_volume") > 0, 0.2, _say(c("negative_volume"), "negative volumes")),
        *[(c(f"not_positive_{p}") > 0, 0.1, _say(c(f"not_positive_{p}"), f"zero or negative prices in {p}")) for p in PRICES],
    ]
    price = []
    for p in PRICES:
        price.append((c(f"jumps_{p}") > 0, 0.2, _say(c(f"jumps_{p}"), f"extreme changes in {p}")))
        price.append((c(f"outliers_{p}") > c("n") * 0.01, 0.1, _say(c(f"outliers_{p}"), f"outliers in {p}")))
    volume = [
        (c("volume_spikes") > 0, 0.3, _say(c("volume_spikes"), "volume spikes")),
        (c("low_volume") > c("n") * 0.05, 0.2, _say(c("low_volume"), "rows of very low volume")),
        (c("volume_cv") < 0.1, 0.2, F.lit("volume too uniform")),
    ]
    regular = ((c("one_step") == 1) & (c("shortest_step") > 0)) | (
        (c("one_month_step") == 1) & (c("whole_months") == c("n_steps")) & (c("shortest_step") > 0)
    )
    temporal = [
        (c("max_gap_hours") > MAX_GAP_HOURS, 0.3, _say(c("large_gaps"), "gaps")),
        (c("unordered") > 0, 0.4, F.lit("not in chronological order")),
        ((c("n") > 2) & ~regular, 0.2, F.lit("no regular frequency")),
    ]
    ohlc = [
        (c("high_violations") > 0, 0.3, _say(c("high_violations"), "rows with high below open or close")),
        (c("low_violations") > 0, 0.3, _say(c("low_violations"), "rows with low above open or close")),
        (c("high_low_violations") > 0, 0.4, _say(c("high_low_violations"), "rows with high below low")),
    ]
    statistics = []
    for x in NUMERIC:
        varies = c(f"constant_{x}") == 0
        statistics += [
            (~varies, 0.2, F.lit(f"{x} is constant")),
            (varies & (F.abs(c(f"skew_{x}")) > 5), 0.1, F.lit(f"{x} is highly skewed")),
            (varies & (c(f"infinite_{x}") > 0), 0.3, F.lit(f"{x} holds infinite values")),
        ]
    outside = [(c(f"missing_{x}") > c("n") * 0.2, 0.1, F.lit(f"{x} is mostly missing")) for x in external]
    if external:
        weak = F.lit(False)
        for x in external:
            weak = weak | F.coalesce(c(f"corr_{x}") < MIN_CORRELATION, F.lit(False))
        outside.append((weak, 0.2, F.lit("external columns barely related to the close")))
    return {
        "completeness": completeness,
        "consistency": _scored("Data Consistency", consistency),
        "price": _scored("Price Integrity", price),
        "volume": _scored("Volume Integrity", volume),
        "temporal": _scored("Temporal Integrity", temporal),
        "ohlc": _scored("OHLC Relationships", ohlc),
        "statistics": _scored("Statistical Properties", statistics, 0.7),
        "external": _scored("External Data Alignment", outside, 0.6),
    }


def quality_checks(measures: DataFrame, which: Sequence[str] | None = None, keys: Sequence[str] = KEYS, external: Sequence[str] = ()) -> DataFrame:
    """One result row per series and check."""
    checks = check_columns(external)
    picked = [checks[n] for n in (which or checks)]
    return measures.select(*keys, F.explode(F.array(*picked)).alias("r")).select(*keys, "r.*")


def overall_score(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted scores over the sum of the named weights; the unnamed checks can lift it above 1."""
    weight = F.lit(OTHER_WEIGHT)
    for name, x in WEIGHTS.items():
        weight = F.when(F.col("check_name") == name, x).otherwise(weight)
    return results.groupBy(*keys).agg((F.sum(F.col("score") * weight) / sum(WEIGHTS.values())).alias("overall_score"))


ADVICE_CORRELATED = "leave out columns that repeat others"


def recommendations(results: DataFrame, indicators: DataFrame, keys: Sequence[str] = KEYS, has_external: bool = False) -> DataFrame:
    """Advice for failed checks and for the profile."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    failed = results.where("NOT passed").select(*keys, F.element_at(advice, F.col("check_name")).alias("advice")).where("advice IS NOT NULL")
    low = indicators.where("overall_quality < 0.8").select(*keys, F.lit("enhance the data set as a whole").alias("advice"))
    out = failed.unionByName(low)
    if not has_external:
        out = out.unionByName(indicators.select(*keys, F.lit("add external sources").alias("advice")))
    return out


def quality_indicators(df: DataFrame, keys: Sequence[str] = KEYS, distinct_on: Sequence[str] = ("ts", *NUMERIC)) -> DataFrame:
    """Completeness, consistency (exact copies), validity and their mean.

    Copies are counted by grouping equal rows first, so a hot row combines on the map side.
    """
    grouped = df.groupBy(*keys, *distinct_on).agg(F.count("*").alias("__m"))
    m = F.col("__m")

    def cells(cond: Column) -> Column:
        return F.sum(F.when(cond, m).otherwise(0))

    missing = sum(cells(F.col(c).isNull()) for c in distinct_on)
    invalid = cells(F.col("volume") < 0) + sum(cells(F.col(c) <= 0) for c in PRICES)
    g = grouped.groupBy(*keys).agg(
        F.sum(m).alias("n_rows"), F.count("*").alias("n_distinct"), missing.alias("missing_cells"), invalid.alias("invalid_cells")
    )
    n = F.col("n_rows").cast("double")
    g = g.withColumns(
        {
            "duplicate_rows": F.col("n_rows") - F.col("n_distinct"),
            "completeness": 1 - F.col("missing_cells") / (n * len(distinct_on)),
            "consistency": 1 - (F.col("n_rows") - F.col("n_distinct")) / n,
            "validity": 1 - F.col("invalid_cells") / (n * 5),
        }
    )
    return g.withColumn("overall_quality", (F.col("completeness") + F.col("consistency") + F.col("validity")) / 3)


def column_profile(df: DataFrame, columns: Sequence[str] = tuple(NUMERIC), keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, moments, quartiles, zeros and 1.5-IQR outliers per series and column."""
    keys = list(keys)
    long = df.unpivot(keys, list(columns), "column", "x")
    by = [*keys, "column"]
    ordered = long.groupBy(*by).agg(F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("v"))
    q = ordered.select(*by, F.array(*[_quantile(F.col("v"), p) for p in (0.25, 0.5, 0.75)]).alias("q"))
    x, q1, q3 = F.col("x"), F.col("q")[0], F.col("q")[2]
    outlier = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
    return long.join(q, by).groupBy(*by).agg(
        F.count("*").alias("n_rows"), _n(x.isNull()).alias("missing"), F.count_distinct("x").alias("n_distinct"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.max(F.col("q")[1]).alias("median"), adjusted_skew(x).alias("skew"), adjusted_kurtosis(x).alias("kurtosis"),
        _n(outlier).alias("outliers"), _n(x == 0).alias("zeros"),
    )


def ts_profile(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Span, most frequent step (the smallest on ties), largest gap, gaps over twice the usual step."""
    keys = list(keys)
    w = series_window(keys, order)
    steps = df.select(*keys, "ts", (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))).alias("step"))
    counted = steps.groupBy(*keys, "step").agg(F.count("*").alias("m"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    usual = counted.where("step IS NOT NULL").groupBy(*keys).agg(F.max_by(F.col("step"), F.col("m") * 4294967296 - F.col("step")).alias("usual"))
    d = counted.join(usual, keys, "left")
    return d.groupBy(*keys).agg(
        F.unix_timestamp(F.min("a")).alias("start"), F.unix_timestamp(F.max("z")).alias("end"),
        F.sum("m").alias("periods"), F.max("usual").alias("usual_step"), (F.max("step") / 3600).alias("max_gap_hours"),
        F.sum(F.when(F.col("step") > 2 * F.col("usual"), F.col("m")).otherwise(0)).alias("wide_gaps"),
    ).withColumn("days", F.floor((F.col("end") - F.col("start")) / 86400))


def drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str] = tuple(NUMERIC), keys: Sequence[str] = KEYS) -> DataFrame:
    """Relative change of mean and standard deviation per series and column; above 0.1 is significant."""
    def stats(df: DataFrame, side: str) -> DataFrame:
        long = df.unpivot(list(keys), list(columns), "column", "x")
        return long.groupBy(*keys, "column").agg(F.avg("x").alias(f"{side}_mean"), F.stddev_samp("x").alias(f"{side}_std"))

    d = stats(baseline, "baseline").join(stats(current, "current"), [*keys, "column"])

    def moved(what: str) -> Column:
        a, b = F.col(f"baseline_{what}"), F.col(f"current_{what}")
        return F.when(a == 0, F.lit(0.0)).otherwise(F.abs(a - b) / F.abs(a))

    d = d.withColumn("drift_score", (moved("mean") + moved("std")) / 2)
    return d.withColumn("significant", F.when(F.col("drift_score") > 0.1, 1).otherwise(0))


def drift_summary(drifted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean drift per series and the names of its significantly drifted columns."""
    named = F.array_sort(F.collect_list(F.when(F.col("significant") == 1, F.col("column"))))  # of a series' columns
    return drifted.groupBy(*keys).agg(F.avg("drift_score").alias("overall_drift"), F.array_join(named, ", ").alias("drifted_columns"))


def correlation_summary(matrix: DataFrame, high: float = 0.8, many: int = 5) -> DataFrame:
    """One row: largest and mean absolute correlation, number of pairs above ``high``, and advice if they are many."""
    r = F.abs("r")
    g = matrix.agg(F.max(r).alias("max_abs_r"), F.avg(r).alias("mean_abs_r"), F.count(F.when(r > high, 1)).alias("high_pairs"))
    return g.withColumn("advice", F.when(F.col("high_pairs") > many, F.lit(ADVICE_CORRELATED)))


def quality_improvement(before: DataFrame, after: DataFrame, columns: Sequence[str], extra_columns: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Reduction of missing cells, gain in completeness and share of added columns."""
    def missing(df: DataFrame, side: str, width: int) -> DataFrame:
        total = sum(_n(F.col(c).isNull()) for c in columns)
        return df.groupBy(*keys).agg(total.alias(f"{side}_missing"), (F.count("*") * width).alias(f"{side}_cells"))

    width = len(columns)
    d = missing(before, "before", width).join(missing(after, "after", width + extra_columns), list(keys))
    b, a = F.col("before_missing"), F.col("after_missing")
    return d.select(
        *keys,
        F.coalesce(ratio((b - a).cast("double"), b.cast("double")), F.lit(0.0)).alias("missing_data_reduction"),
        (b / F.col("before_cells") - a / F.col("after_cells")).alias("data_completeness_improvement"),
        F.lit(extra_columns / width).alias("additional_features_ratio"),
    )
