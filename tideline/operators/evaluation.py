"""Evaluation of forecasts: errors, trading and risk figures, panel scores, rankings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.metrics import COMBINATIONS, DIRECTIONAL, METRICS
from tideline.functions.nulls import ratio
from tideline.functions.rolling import series_window, so_far

BY = ("model", "series_key")


def with_changes(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("ts",)) -> DataFrame:
    w = series_window(by, order)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in ("actual", "predicted")})


def evaluate(df: DataFrame, names: Sequence[str], by: Sequence[str] = BY, order: Sequence[str] = ("ts",), windows: Sequence[str] | None = None) -> DataFrame:
    """Named metrics per group. Changes are taken inside ``windows`` (default: the groups)."""
    by = list(by)
    if DIRECTIONAL & set(names):
        df = with_changes(df, windows or by, order)
    stats = []
    if "corr_ratio" in names:
        stats += [F.avg("actual").alias("mean_actual"), F.avg("predicted").alias("mean_predicted")]
    if "robust_huber" in names:
        stats.append(F.percentile(F.abs(F.col("predicted") - F.col("actual")), F.lit(0.75)).alias("delta"))
    if stats:
        df = df.join(df.groupBy(*by).agg(*stats), by)
    return df.groupBy(*by).agg(*[METRICS[n]().alias(n) for n in names])


def weighted_losses(metrics: DataFrame, combinations: dict[str, list[str]] | None = None) -> DataFrame:
    """Equal-weight mix of the losses of each named combination."""
    mixes = combinations or COMBINATIONS
    return metrics.withColumns({n: sum(F.col(x) for x in xs) / len(xs) for n, xs in mixes.items()})


def loss_weights(history: DataFrame, step: str = "step", keys: Sequence[str] = ("series_key",), window: int = 10, least: float = 0.05, most: float = 0.8) -> DataFrame:
    """One weight update from the last ``window`` losses per series and loss name.

    Score = mean + 0.1 |last - first| + 0.05 std; lower is better. Scores are inverted,
    normalised, blended 0.3 to 0.7 with equal weights, limited and normalised again.
    ``history`` is (keys, loss_name, step, value). As long as any loss of a series has fewer than
    ``window`` values, its weights stay equal.
    """
    keys = list(keys)
    last = Window.partitionBy(*keys, "loss_name").orderBy(F.desc(step))
    recent = history.withColumn("__k", F.row_number().over(last)).where(f"__k <= {window}")
    s = recent.groupBy(*keys, "loss_name").agg(
        (F.avg("value") + 0.1 * F.abs(F.max_by("value", step) - F.min_by("value", step)) + 0.05 * F.stddev_pop("value")).alias("score"),
        F.count("value").alias("__n"),
    )
    w = Window.partitionBy(*keys)  # one row per loss name
    inverted = F.max("score").over(w) - F.col("score") + F.min("score").over(w)
    s = s.withColumns({"__inv": inverted, "__m": F.count("*").over(w), "__flat": (F.max("score").over(w) <= F.min("score").over(w)) | (F.min("__n").over(w) < window)})
    share = ratio(F.col("__inv"), F.sum("__inv").over(w))
    limited = F.least(F.greatest(0.7 / F.col("__m") + 0.3 * share, F.lit(least)), F.lit(most))
    s = s.withColumn("__lim", limited)
    weight = F.when(F.col("__flat"), 1 / F.col("__m")).otherwise(ratio(F.col("__lim"), F.sum("__lim").over(w)))
    return s.select(*keys, "loss_name", "score", weight.alias("weight"))


def history_summary(history: DataFrame, step: str = "step", by: Sequence[str] = ("series_key", "loss_name")) -> DataFrame:
    first, last = F.min_by("value", step), F.max_by("value", step)
    return history.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        (last - first).alias("trend"), last.alias("final"), (ratio(first - last, first) * 100).alias("improvement_pct"),
    )


# --- trading -------------------------------------------------------------------------------

def strategy_returns(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("ts",), cost: float = 0.001) -> DataFrame:
    """Gross and net return of following the predicted direction, one row per period.

    The return of period i pays for the change of direction from i to i+1, the last period
    is dropped and the entry is free.
    """
    w = series_window(by, order)
    a, p = F.col("actual"), F.col("predicted")
    d = df.withColumns(
        {
            "ret": ratio(F.lead("actual").over(w) - a, a),
            "diff": F.lead("actual").over(w) - a,
            "dir": F.signum(F.lead("predicted").over(w) - p),
            "next_dir": F.signum(F.lead("predicted", 2).over(w) - F.lead("predicted").over(w)),
        }
    ).where(F.col("next_dir").isNotNull())
    d = d.withColumns({"gross": F.col("dir") * F.col("ret"), "paid": F.abs(F.col("next_dir") - F.col("dir")) * cost})
    d = d.withColumn("net", F.col("gross") - F.col("paid"))
    d = d.withColumn("cum", F.product(1 + F.col("net")).over(so_far(w)))
    return d.withColumn("peak", F.max("cum").over(so_far(w)))


def trading_metrics(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("ts",), cost: float = 0.001, per_year: int = 8760, benchmark: float = 0.0) -> DataFrame:
    """Fourteen trading figures per group."""
    r = strategy_returns(df, by, order, cost)
    net, gross, traded = F.col("net"), F.col("gross"), F.col("dir") != 0
    wins, losses = F.when(traded & (gross > 0), gross), F.when(traded & (gross < 0), gross)
    g = r.groupBy(*by).agg(
        F.count("*").alias("__n"), (F.max_by("cum", order[-1]) - 1).alias("total_return"), F.stddev_pop("net").alias("__sd"), F.avg("net").alias("__mean"),
        F.min(ratio(F.col("cum") - F.col("peak"), F.col("peak"))).alias("max_drawdown"),
        F.stddev_pop(F.when(net < 0, net)).alias("__down"),
        F.coalesce(F.avg(F.when(traded, F.when(gross > 0, 1.0).otherwise(0.0))), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.avg(wins), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(losses), F.lit(0.0)).alias("avg_loss"),
        F.count(F.when(traded, 1)).alias("total_trades"), F.sum("paid").alias("transaction_cost_impact"),
    )
    root = math.sqrt(per_year)
    g = g.withColumns(
        {
            "annualized_return": F.when(1 + F.col("total_return") >= 0, F.pow(1 + F.col("total_return"), per_year / F.col("__n")) - 1),
            "annualized_volatility": F.col("__sd") * root,
        }
    )
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    year = F.col("annualized_return")
    excess = (F.col("__mean") - benchmark / per_year) * per_year
    g = g.withColumns(
        {
            "sharpe_ratio": zero(ratio(year, F.col("annualized_volatility"))),
            "sortino_ratio": zero(ratio(year, F.col("__down") * root)),
            "calmar_ratio": zero(ratio(year, F.abs("max_drawdown"))),
            "information_ratio": zero(ratio(excess, F.col("annualized_volatility"))),
            "profit_factor": zero(F.abs(ratio(F.col("avg_win"), F.col("avg_loss")))),
        }
    )
    return g.drop("__n", "__sd", "__mean", "__down")


def window_trading_metrics(df: DataFrame, by: Sequence[str] = BY, order: Sequence[str] = ("ts",), cost: float = 0.001, per_year: int = 8760) -> DataFrame:
    """Sharpe, drawdown, win rate and gross profit over gross loss per validation window."""
    r = strategy_returns(df, by, order, cost)
    net = F.col("net")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return r.groupBy(*by).agg(
        zero(math.sqrt(per_year) * ratio(F.avg("net"), F.stddev_pop("net"))).alias("sharpe_ratio"),
        F.min(ratio(F.col("cum") - F.col("peak"), F.col("peak"))).alias("max_drawdown"),
        F.avg(F.when(net > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        zero(ratio(F.sum(F.when(net > 0, net)), F.abs(F.sum(F.when(net < 0, net))))).alias("profit_factor"),
    )


def value_at_risk(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """5th and 1st percentile and the mean of the values at or below the 5th."""
    by = list(by)
    q = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.05), F.lit(0.01))).alias("__q"))
    return df.join(q, by).groupBy(*by).agg(
        F.max(F.col("__q")[0]).alias("var_95"), F.max(F.col("__q")[1]).alias("var_99"),
        F.avg(F.when(F.col(column) <= F.col("__q")[0], F.col(column))).alias("expected_shortfall"),
    )


def regime_metrics(df: DataFrame, by: Sequence[str] = BY, regime: str = "regime", least_rows: int = 11, **kw) -> DataFrame:
    """Trading figures per regime of more than ten rows; rows of one regime are joined over gaps."""
    groups = [*by, regime]
    sizes = df.groupBy(*groups).agg(F.count("*").alias("regime_periods"))
    total = sizes.groupBy(*by).agg(F.sum("regime_periods").alias("__t"))
    m = trading_metrics(df, groups, **kw).join(sizes.where(f"regime_periods >= {least_rows}"), groups).join(total, list(by))
    return m.withColumn("regime_percentage", F.col("regime_periods") / F.col("__t") * 100).drop("__t")


def model_score() -> Column:
    """Weighted score of mape (percent), r2, sharpe_ratio, win_rate and max_drawdown."""
    zero = F.lit(0.0)
    parts = [
        (0.2, F.greatest(zero, 1 - F.col("mape") / 100)), (0.2, F.greatest(zero, F.col("r2"))),
        (0.3, F.least(F.lit(1.0), F.greatest(zero, F.col("sharpe_ratio") / 2))), (0.2, F.least(F.lit(1.0), F.col("win_rate"))),
        (0.1, F.greatest(zero, 1 + F.col("max_drawdown") / 0.5)),
    ]
    return sum(w * x for w, x in parts)


def dataset_label(model: str = "model", prefix: str = "") -> Column:
    """Data set a model was trained on, by its name; the first match counts."""
    n = F.upper(F.col(model))
    label = F.when(n.contains("EXTERNAL"), "EXTERNAL").when(n.contains("MULTISCALE"), "MULTISCALE").when(n.contains("ENHANCED"), "ENHANCED").otherwise("BASIC")
    return F.concat(F.lit(prefix), label)


def model_ranking(scores: DataFrame, by: Sequence[str] = (), score: str = "score", min_sharpe: float = 0.5, min_win_rate: float = 0.45, max_drawdown: float = 0.2) -> DataFrame:
    """Rank by score (ties by model name) with threshold verdicts and the strengths of the top three."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), "model")
    sharpe, win, loss = F.col("sharpe_ratio"), F.col("win_rate"), F.abs("max_drawdown")
    d = scores.withColumn("place", F.row_number().over(w))
    strengths = F.concat_ws(", ", F.when(sharpe > 1.0, "risk-adjusted return"), F.when(win > 0.6, "win rate"), F.when(loss < 0.1, "drawdown"))
    return d.withColumns(
        {
            "sharpe_ok": (sharpe >= min_sharpe).cast("int"), "win_rate_ok": (win >= min_win_rate).cast("int"),
            "drawdown_ok": (loss <= max_drawdown).cast("int"), "strengths": F.when(F.col("place") <= 3, strengths),
        }
    )


# --- folds, panel, detection ---------------------------------------------------------------

def cv_aggregate(folds: DataFrame, metric: str, by: Sequence[str], fold: str = "fold", weight: str = "n_test") -> DataFrame:
    """Mean, median, weighted mean, spread and best and worst fold of a metric."""
    m = F.col(metric)
    return folds.where(m.isNotNull() & ~F.isnan(m)).groupBy(*by).agg(
        F.avg(m).alias("mean"), F.percentile(metric, F.lit(0.5)).alias("median"),
        (F.sum(m * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.stddev_pop(m).alias("std"),
        F.min_by(fold, m).alias("best_fold"), F.max_by(fold, m).alias("worst_fold"),
    )


def masked_losses(df: DataFrame, scale: DataFrame, by: Sequence[str]) -> DataFrame:
    """Masked MAPE, sMAPE and MASE; a quotient without value counts as 0.

    ``df`` is (by, actual, predicted, mask); ``scale`` is (by, naive_mae), the mean absolute
    seasonal difference of the series before the forecast.
    """
    d = df.join(scale, list(by), "left")
    f, a, m = F.col("predicted"), F.col("actual"), F.col("mask")
    none = lambda x: F.coalesce(x, F.lit(0.0))
    return d.groupBy(*by).agg(
        F.avg(F.abs((f - a) * none(ratio(m, a)))).alias("mape"),
        (200 * F.avg(none(ratio(F.abs(f - a), F.abs(f) + F.abs(a))) * m)).alias("smape"),
        F.avg(F.abs(a - f) * none(ratio(m, F.col("naive_mae")))).alias("mase"),
    )


def panel_scores(points: DataFrame, scale: DataFrame, majors: Sequence[str]) -> DataFrame:
    """sMAPE, MAPE, MASE and OWA against a naive model per group, 'Others' and 'Average'.

    ``points`` is (series_id, grp, actual, predicted, naive); ``scale`` (series_id, naive_mae).
    Groups outside ``majors`` are pooled as 'Others', weighted by their number of series.
    """
    a, f, z = F.col("actual"), F.col("predicted"), F.col("naive")

    def smape(x: Column) -> Column:
        total = F.abs(a) + F.abs(x)
        return 200 * F.abs(x - a) / F.when(total == 0, 1.0).otherwise(total)

    series = points.groupBy("grp", "series_id").agg(
        F.count("*").alias("m"), F.sum(smape(f)).alias("s"), F.sum(smape(z)).alias("zs"),
        F.sum(100 * F.abs(f - a) / F.when(a == 0, 1.0).otherwise(F.abs(a))).alias("p"),
        F.avg(F.abs(f - a)).alias("e"), F.avg(F.abs(z - a)).alias("ze"),
    ).join(scale, "series_id")
    groups = series.groupBy("grp").agg(
        F.count("*").cast("double").alias("k"), (F.sum("s") / F.sum("m")).alias("smape"), (F.sum("p") / F.sum("m")).alias("mape"),
        F.avg(ratio(F.col("e"), F.col("naive_mae"))).alias("mase"), (F.sum("zs") / F.sum("m")).alias("naive_smape"),
        F.avg(ratio(F.col("ze"), F.col("naive_mae"))).alias("naive_mase"),
    )
    name = F.when(F.col("grp").cast("string").isin([str(x) for x in majors]), F.col("grp").cast("string")).otherwise("Others")
    figures = ["smape", "mape", "mase", "naive_smape", "naive_mase"]
    pooled = groups.withColumn("name", F.explode(F.array(name, F.lit("Average")))).groupBy("name").agg(
        *[(F.sum(F.col(x) * F.col("k")) / F.sum("k")).alias(x) for x in figures]
    )
    owa = (F.col("mase") / F.col("naive_mase") + F.col("smape") / F.col("naive_smape")) / 2
    return pooled.select("name", *[F.round(x, 3).alias(x) for x in ("smape", "mape", "mase")], F.round(owa, 3).alias("owa"))


def point_adjust(df: DataFrame, by: Sequence[str], order: Sequence[str], truth: str = "truth", hit: str = "hit") -> DataFrame:
    """A labelled segment with any hit counts as hit everywhere, but for the series' first row."""
    w = series_window(by, order)
    starts = F.when(F.col(truth) != F.coalesce(F.lag(truth).over(w), F.lit(-1)), 1).otherwise(0)
    d = df.withColumns({"__i": F.row_number().over(w), "__start": starts})
    d = d.withColumn("__seg", F.sum("__start").over(so_far(w)))
    any_hit = F.max(hit).over(Window.partitionBy(*by, "__seg"))
    adjusted = F.when((F.col(truth) == 1) & (F.col("__i") > 1), any_hit).otherwise(F.col(hit))
    return d.withColumn("adjusted", adjusted).drop("__i", "__start", "__seg")
