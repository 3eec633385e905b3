"""Analytics of trial logs: convergence, importance, distributions, fronts, summaries.

A study may hold any share of all trials, so everything ordered runs over slices of the
unique trial number (``ordered.running``) and quantiles come from counted values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.nulls import INF, correlation, ratio, text_hash
from tideline.operators.ordered import exact_quantiles, id_bucket, running, value_slices
from tideline.session import written


def valid(trials: DataFrame) -> DataFrame:
    v = F.col("value")
    return trials.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INF))


def running_best(trials: DataFrame, by: Sequence[str] = ("study",), width: int = 65_536) -> DataFrame:
    """Add the smallest value so far and the 0-based position of the trial."""
    out = running(
        valid(trials), by, ["trial_id"], {"best_so_far": ("min", F.col("value")), "position": ("count", F.lit(1))}, id_bucket("trial_id", width)
    )
    return out.withColumn("position", F.col("position") - 1)


def _totals(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    return valid(trials).groupBy(*by).agg(
        F.count("*").alias("total_trials"), F.min_by("value", "trial_id").alias("initial_value"), F.max_by("value", "trial_id").alias("final_value"),
        F.min("value").alias("best_value"), F.avg("value").alias("__mean"), F.stddev_pop("value").alias("__sd"),
    )


def convergence(trials: DataFrame, by: Sequence[str] = ("study",), threshold: float = 0.001, flat: float = 0.0001, width: int = 65_536) -> DataFrame:
    """First, last and best value, when the running best stopped improving and for how long it stayed."""
    by = list(by)
    t = _totals(trials, by).where("total_trials >= 3")
    r = running_best(trials, by, width).select(*by, "position", "best_so_far").join(t, by)
    b, n = F.col("best_so_far"), F.col("total_trials")
    moving = (F.col("position").between(1, n - 10)) & (F.coalesce(ratio(b - F.col("best_value"), b), F.lit(0.0)) > threshold)
    level = F.coalesce(ratio(F.abs(b - F.col("best_value")), F.col("best_value")), F.lit(0.0)) <= flat
    g = r.groupBy(*by).agg(F.max(F.when(moving, F.col("position"))).alias("__at"), F.count(F.when(level, 1)).alias("plateau_length"))
    return t.join(g, by).select(
        *by, "total_trials", "initial_value", "final_value", "best_value",
        F.coalesce(ratio(F.col("initial_value") - F.col("best_value"), F.col("initial_value")), F.lit(0.0)).alias("improvement_ratio"),
        F.coalesce(F.col("__at") + 10, n).alias("convergence_trial"), "plateau_length",
        F.coalesce(ratio(F.col("__sd"), F.col("__mean")), F.lit(0.0)).alias("volatility"),
    )


def convergence_rate(trials: DataFrame, by: Sequence[str] = ("study",), grid: Sequence[float] = (0.01, 0.02, 0.05, 0.1, 0.2), width: int = 65_536) -> DataFrame:
    """Decay a * exp(-b x) + c of the running best: c from a grid below the best value, b by regression.

    All grid points are regressions of ln(y - c) on the position in one aggregate pass.
    """
    by = list(by)
    r = running_best(trials, by, width).join(_totals(trials, by), by)
    drop = F.col("initial_value") - F.col("best_value")
    aggs = []
    for i, g in enumerate(grid):
        y = F.ln(F.col("best_so_far") - (F.col("best_value") - g * drop))
        y = F.when(drop > 0, y)
        x = F.col("position").cast("double")
        aggs += [F.regr_r2(y, x).alias(f"__r{i}"), F.regr_slope(y, x).alias(f"__b{i}")]
    aggs += [F.max("best_value").alias("__best"), F.max(drop).alias("__drop")]
    fits = F.array(
        *[F.struct(F.coalesce(F.round(f"__r{i}", 9), F.lit(0.0)).alias("r_squared"), F.lit(-float(i)).alias("i"), (-F.col(f"__b{i}")).alias("decay_constant"),
                   (F.col("__best") - g * F.col("__drop")).alias("asymptote")) for i, g in enumerate(grid)]
    )
    best = F.array_max(fits)
    return r.groupBy(*by).agg(*aggs).withColumn("f", best).select(
        *by, "f.decay_constant", "f.asymptote", "f.r_squared", F.when(F.col("f.r_squared") > 0.8, 1).otherwise(0).alias("converged")
    )


def exploded_params(trials: DataFrame) -> DataFrame:
    return trials.select("*", F.explode("params").alias("param", "setting"))


def param_importance(trials: DataFrame, by: Sequence[str] = ("study",), least: int = 10) -> DataFrame:
    """|r| between each parameter and the value; text by its CRC-32 modulo 1000, constants 0."""
    by = list(by)
    p = exploded_params(valid(trials).select(*by, "params", "value"))
    number = F.expr("try_cast(setting AS DOUBLE)")
    hashed = (F.crc32(F.col("setting").cast("binary")) % 1000).cast("double")
    g = p.groupBy(*by, "param").agg(
        F.count("*").alias("n"), F.count(number).alias("__numbers"), correlation(number, F.col("value")).alias("__rn"), correlation(hashed, F.col("value")).alias("__rh"),
        F.min("setting").alias("__a"), F.max("setting").alias("__z"),
    ).where(f"n >= {least}")
    r = F.when(F.col("__numbers") == F.col("n"), F.col("__rn")).otherwise(F.col("__rh"))
    importance = F.when((F.col("__a") == F.col("__z")) | r.isNull() | F.isnan(r), 0.0).otherwise(F.abs(r))
    return g.select(*by, "param", importance.alias("importance"))


def param_impact(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, spread, count and range of the value per parameter setting."""
    return exploded_params(trials).groupBy(*by, "param", "setting").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def numeric_params(trials: DataFrame, names: Sequence[str]) -> DataFrame:
    return trials.withColumns({n: F.element_at("params", F.lit(n)).try_cast("double") for n in names})


def value_distribution(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Moments, quartiles and how many values fall into five bands cut at p10, p25, p75 and p90."""
    by = list(by)
    v = valid(trials)
    q = exact_quantiles(v, by, "value", [0.1, 0.25, 0.5, 0.75, 0.9])
    names = {0.1: "p10", 0.25: "q25", 0.5: "median", 0.75: "q75", 0.9: "p90"}
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.abs(F.col("prob") - p) < 1e-9, F.col("quantile"))).alias(n) for p, n in names.items()])
    x, cut = F.col("value"), F.col
    band = lambda c: F.count(F.when(c, 1))
    g = v.join(wide, by).groupBy(*by).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
        *[F.max(n).alias(n) for n in ("q25", "median", "q75")],
        band(x <= cut("p10")).alias("excellent"), band((x > cut("p10")) & (x <= cut("q25"))).alias("good"), band((x > cut("q25")) & (x <= cut("q75"))).alias("average"),
        band((x > cut("q75")) & (x <= cut("p90"))).alias("poor"), band(x > cut("p90")).alias("very_poor"),
    )
    return g.withColumn("iqr", F.col("q75") - F.col("q25"))


def pareto_front(points: DataFrame, x: str, y: str, by: Sequence[str] = ("study",), x_low: bool = True, y_low: bool = True, mode: str = "strict") -> DataFrame:
    """Points no other point dominates, without comparing pairs.

    Ordered by x, a point stays if its y is the best at its x and better than the best y of
    all better x: a running minimum over slices of x. ``mode="reference"`` also removes
    points that occur more than once, since equal points eliminate each other there.
    """
    by = list(by)
    p = points.withColumns({"__x": F.col(x) * (1 if x_low else -1), "__y": F.col(y) * (1 if y_low else -1)})
    at = p.groupBy(*by, "__x").agg(F.min("__y").alias("__best"))
    sliced = value_slices(at, by, "__x", name="__slice")
    edge = running(sliced, by, ["__x"], {"__before": ("min", F.col("__best"))}, F.col("__slice"), before=True)
    kept = edge.where(F.col("__before").isNull() | (F.col("__best") < F.col("__before"))).select(*by, "__x", F.col("__best").alias("__y"))
    front = p.join(kept, [*by, "__x", "__y"])
    if mode == "reference":
        single = p.groupBy(*by, "__x", "__y").agg(F.count("*").alias("__m")).where("__m = 1").drop("__m")
        front = front.join(single, [*by, "__x", "__y"], "left_semi")
    return front.drop("__x", "__y")


#: Cells of a group's grid, and points that are compared with each other at first, at most.
CELLS, CHUNK = 256, 2048


def skyline(points: DataFrame, metrics: dict[str, str], by: Sequence[str] = ("study",), mode: str = "strict") -> DataFrame:
    """Points that no other point of their group dominates in any number of metrics, each ``"low"`` or ``"high"`` for better.

    Four steps, each of which only drops points that another one dominates; a point of the front is
    never dropped, and whatever dominates a point is itself dominated by, or is, a point of the front.
    1. A few strong points of each group (the best sum, the best of each metric) drop most of the others.
    2. Points are compared within chunks of about ``CHUNK``.
    3. A grid of quantiles over the metrics: a cell that is above another one in every metric goes as a whole.
    4. A point is compared with those of the cells that are not above its own in any metric.
    All comparisons are anti joins by equal chunks or cells; the grid has at most ``CELLS`` cells a group.

    Equal points are one point until the end and stay together; ``mode="reference"`` removes them, since
    equal points eliminate each other there. Points without a value in every metric are left out.
    """
    by, names = list(by), list(metrics)
    n = len(names)
    sign = {m: 1.0 if better == "low" else -1.0 for m, better in metrics.items()}
    x = F.array(*[F.col(m).cast("double") * sign[m] + F.lit(0.0) for m in names])  # -0.0 becomes 0.0
    p = points.withColumn("__x", x).where(F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v)))
    classes = p.groupBy(*by, "__x").agg(F.count("*").alias("__m"))

    def dominates(a, b):
        """Whether array a is at least as good everywhere and better somewhere."""
        pairs = F.zip_with(a, b, lambda v, w: v <= w)
        return F.forall(pairs, lambda t: t) & (a != b)

    def better(rows: DataFrame, others: DataFrame, on: list[str], how: str) -> DataFrame:
        """Semi or anti join of ``rows`` with those of ``others`` that have equal ``on`` and dominate them."""
        others = others.select(F.col("__x").alias("__o"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)])
        hit = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(on)]
        return rows.join(others, reduce(lambda a, b: a & b, hit, dominates(F.col("__o"), F.col("__x"))), how)

    worth = [F.aggregate("__x", F.lit(0.0), lambda a, v: a + v)] + [F.col("__x")[j] for j in range(n)]
    strong = classes.groupBy(*by).agg(F.array_distinct(F.array(*[F.min(F.struct(w.alias("w"), F.col("__x").alias("x")))["x"] for w in worth])).alias("__strong"))
    left = classes.join(strong, by) if by else classes.crossJoin(F.broadcast(strong))
    left = left.where(~F.exists("__strong", lambda s: dominates(s, F.col("__x")))).drop("__strong")
    # about CHUNK points a chunk, whatever is left of a group
    size = left.groupBy(*by).agg(F.ceil(F.count("*") / CHUNK).alias("__chunks"))
    left = left.join(size, by) if by else left.crossJoin(F.broadcast(size))
    left = written(left.withColumn("__chunk", F.pmod(F.xxhash64("__x"), F.col("__chunks"))).drop("__chunks"), "skyline")
    left = written(better(left, left, [*by, "__chunk"], "left_anti").drop("__chunk"), "skyline")
    steps = max(2, int(CELLS ** (1 / n)))
    at = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    cuts = left.groupBy(*by).agg(F.array(*[F.percentile_approx(F.col("__x")[j], at, F.lit(1000)) for j in range(n)]).alias("__cuts"))
    left = left.join(cuts, by) if by else left.crossJoin(F.broadcast(cuts))
    left = left.withColumn("__cell", F.zip_with("__x", "__cuts", lambda v, c: F.size(F.filter(c, lambda e: e < v)))).drop("__cuts")
    cells = left.select(*by, "__cell").distinct()
    one, two = cells.withColumnRenamed("__cell", "__near"), cells
    pairs = two.join(one, by) if by else two.crossJoin(F.broadcast(one))  # at most CELLS a group
    pairs = pairs.where(F.forall(F.zip_with("__near", "__cell", lambda a, b: a <= b), lambda t: t))
    below = F.forall(F.zip_with("__near", "__cell", lambda a, b: a < b), lambda t: t)
    near = pairs.groupBy(*by, "__cell").agg(F.collect_list("__near").alias("__nears"), F.max(below).alias("__gone")).where("NOT __gone").drop("__gone")
    left = written(left.join(near, [*by, "__cell"]), "skyline")
    asked = left.select(*by, "__x", F.explode("__nears").alias("__cell"))
    lost = better(asked, left, [*by, "__cell"], "left_semi").select(*by, "__x").distinct()
    front = left.join(lost, [*by, "__x"], "left_anti")
    if mode == "reference":
        front = front.where("__m = 1")
    return p.join(front.select(*by, "__x"), [*by, "__x"], "left_semi").select(*points.columns)


def study_summary(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Trials by status, success rate and best value per study."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return trials.groupBy(*by).agg(
        F.count("*").alias("n_trials"), n("completed").alias("successful"), n("failed").alias("failed"), n("pruned").alias("pruned"),
        (n("completed") / F.count("*") * 100).alias("success_rate"), F.min("value").alias("best_value"),
    )


def method_compare(trials: DataFrame, method: Column, by: Sequence[str] = ("study",)) -> DataFrame:
    """Mean and spread of the best value per study, by method."""
    best = trials.groupBy(*by, method.alias("method")).agg(F.min("value").alias("best"))
    return best.groupBy("method").agg(F.avg("best").alias("mean"), F.stddev_pop("best").alias("std"), F.count("*").alias("n"))


def best_params(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Parameters of the lowest value, the earliest trial on ties: a two-step minimum, so that
    the grouping keeps primitive buffers."""
    low = trials.groupBy(*by).agg(F.min("value").alias("value"))
    first = trials.join(low, [*by, "value"]).groupBy(*by).agg(F.min("trial_id").alias("trial_id"))
    return trials.join(first, [*by, "trial_id"])


def run_compare(runs: DataFrame, metrics: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Chosen metrics and parameters side by side with a short run id."""
    return runs.select(
        F.substring("run_id", 1, 8).alias("run_id"), "status", *[F.element_at("metrics", F.lit(m)).alias(m) for m in metrics],
        *[F.element_at("params", F.lit(p)).alias(p) for p in params],
    )


def best_run(runs: DataFrame, metric: str, ascending: bool = True, k: int = 1) -> DataFrame:
    m = F.element_at("metrics", F.lit(metric))
    order = F.asc_nulls_last("best_metric") if ascending else F.desc_nulls_last("best_metric")
    return runs.withColumn("best_metric", m).orderBy(order, "run_id").limit(k)


def random_params(rows: DataFrame, key: str, space: dict[str, dict], seed: int = 42) -> DataFrame:
    """One seeded draw of every parameter per row, then made consistent.

    Draws are hashes of (seed, key, name): the same again when a lost task is run anew.
    """
    def uniform(name: str) -> Column:
        return text_hash(F.lit(seed), F.col(key), F.lit(name)) / float(2**52)

    out = {}
    for name, s in space.items():
        u = uniform(name)
        if s["type"] == "categorical":
            choices = F.array(*[F.lit(c) for c in s["choices"]])
            out[name] = F.element_at(choices, (F.floor(u * len(s["choices"])) + 1).cast("int"))
        elif s["type"] == "int":
            out[name] = (F.floor(u * (s["high"] - s["low"] + 1)) + s["low"]).cast("int")
        elif s["type"] == "float":
            out[name] = u * (s["high"] - s["low"]) + s["low"]
        else:
            out[name] = F.exp(u * (F.ln(F.lit(s["high"])) - F.ln(F.lit(s["low"]))) + F.ln(F.lit(s["low"])))
    d = rows.select(key, *[c.alias(n) for n, c in out.items()])
    if "seq_len" in out:
        d = d.withColumn("label_len", F.least(F.floor(F.col("seq_len") / 2), F.lit(48)).cast("int"))
    if "stride" in out and "patch_len" in out:
        d = d.withColumn("stride", F.least("stride", "patch_len"))
    if "d_model" in out and "n_heads" in out:
        d = d.withColumn("d_model", F.greatest((F.floor(F.col("d_model") / F.col("n_heads")) * F.col("n_heads")).cast("int"), F.col("n_heads")))
    return d


