"""Signals, back-tests as window queries, parameter sweeps, leaderboards.

A signal is 1 (buy), -1 (sell) or 0. A back-test is all in or all out: the position after a
row is the last non-zero signal so far (out before the first), a trade happens where the
position changes, and the equity is the running product of one factor per row. Cumulative
values need one window per (series, model, strategy); on bar tables the rows of a group are
bounded by the calendar, not by the number of ticks. For ticks ``backtest`` takes a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.nulls import ratio
from tideline.functions.rolling import pct_change, series_window, sma, so_far
from tideline.operators.ordered import running
from tideline.session import written

BY = ("model", "series_key")


def _sign_beyond(x: Column, limit: float | Column) -> Column:
    limit = F.lit(limit) if isinstance(limit, (int, float)) else limit
    return F.when(x > limit, 1).when(x < -limit, -1).otherwise(0)


def _filled(prediction: str, w) -> Column:
    return F.last(prediction, ignorenulls=True).over(so_far(w))


def signal_threshold(df: DataFrame, change: float | Column = 0.0, horizon: int = 0, by: Sequence[str] = BY, price="close", prediction="predicted", name="signal") -> DataFrame:
    """Prediction against price; with a horizon, prediction i+1 against prediction i-h+1."""
    w = series_window(by)
    d = df.withColumn("__p", _filled(prediction, w))
    if horizon < 1:
        s = _sign_beyond(ratio(F.col("__p") - F.col(price), F.col(price)), change)
    else:
        before = F.lag("__p", horizon - 1).over(w) if horizon > 1 else F.col("__p")
        inside = (F.row_number().over(w) > horizon) & F.lead("__p").over(w).isNotNull()
        s = F.when(inside, _sign_beyond(ratio(F.lead("__p").over(w) - before, before), change)).otherwise(0)
    return d.withColumn(name, s).drop("__p")


def signal_threshold_lag(df: DataFrame, change: float = 0.0, by: Sequence[str] = BY, price="close", prediction="predicted", name="signal") -> DataFrame:
    """Older rule: the prediction of the row before against the price."""
    x = ratio(F.lag(prediction).over(series_window(by)) - F.col(price), F.col(price))
    return df.withColumn(name, _sign_beyond(x, change))


def signal_directional(df: DataFrame, confidence: float | Column = 0.01, by: Sequence[str] = BY, prediction="predicted", name="signal") -> DataFrame:
    """Direction of the prediction where it moves by more than the confidence."""
    w = series_window(by)
    d = df.withColumn("__p", _filled(prediction, w))
    limit = F.lit(confidence) if isinstance(confidence, float) else confidence
    move = F.col("__p") - F.lag("__p").over(w)
    s = F.when(F.abs(pct_change(F.col("__p"), w)) > limit, F.signum(move).cast("int")).otherwise(0)
    return d.withColumn(name, F.coalesce(s, F.lit(0))).drop("__p")


def signal_hybrid(df: DataFrame, short=5, long=20, weight=0.7, by: Sequence[str] = BY, price="close", prediction="predicted", name="signal") -> DataFrame:
    """Prediction and moving-average direction, weighted; a missing average counts as down."""
    w = series_window(by)
    d = df.withColumns({"__p": _filled(prediction, w), "__s": sma(F.col(price), short, w), "__l": sma(F.col(price), long, w)})
    tech = F.when(F.col("__s") > F.col("__l"), 1.0).otherwise(-1.0)
    pred = F.when(F.col("__p") > F.col(price), 1.0).otherwise(-1.0)
    return d.withColumn(name, _sign_beyond(weight * pred + (1 - weight) * tech, 0.3)).drop("__p", "__s", "__l")


def signal_buy_hold(df: DataFrame, by: Sequence[str] = BY, name="signal") -> DataFrame:
    """Buy on the first row, sell on the last."""
    w = series_window(by)
    return df.withColumn(name, F.when(F.row_number().over(w) == 1, 1).when(F.lead("ts").over(w).isNull(), -1).otherwise(0))


# --- back-test -----------------------------------------------------------------------------

def backtest(df: DataFrame, by: Sequence[str] = BY, signal="signal", price="close", fee: float | Column = 0.0, capital: float = 1000.0,
             order: Sequence[str] = ("ts",), bucket: Column | None = None) -> DataFrame:
    """Add ``state, side, ret, equity, peak, won`` per row; ``side`` is buy, sell or NULL.

    ``bucket`` (a slice along the order) runs every cumulative step as a two-level scan, for
    series without a row bound; the equity is then the exponential of a running sum.
    """
    fee = F.lit(fee) if isinstance(fee, float) else fee
    order = list(order)
    cut = (lambda d: d) if bucket is None else written
    nonzero = F.when(F.col(signal) != 0, F.col(signal))
    first = {"state": ("last", nonzero), "__held": ("last", nonzero, True), "__before": ("last", F.col(price), True)}
    d = cut(running(df, by, order, first, bucket))
    out = F.lit(-1)
    d = d.withColumns({"state": F.coalesce("state", out), "__held": F.coalesce("__held", out)})
    traded = F.col("state") != F.col("__held")
    growth = F.when(F.col("__held") == 1, F.col(price) / F.col("__before")).otherwise(F.lit(1.0))
    factor = growth * F.when(traded, 1 - fee).otherwise(F.lit(1.0))
    d = d.withColumns(
        {
            "side": F.when(traded, F.when(F.col("state") == 1, "buy").otherwise("sell")),
            "__factor": factor,
            "ret": F.when(F.col("__before").isNull(), 0.0).otherwise(factor - 1),
        }
    )
    second = {"__entry": ("last", F.when(F.col("side").isNotNull(), F.col(price)), True)}
    if bucket is None:
        d = running(d, by, order, second)
        d = d.withColumn("equity", capital * F.product("__factor").over(so_far(series_window(by, order))))
    else:
        d = cut(running(d, by, order, second | {"__log": ("sum", F.ln("__factor"))}, bucket))
        d = d.withColumn("equity", capital * F.exp("__log")).drop("__log")
    d = running(d, by, order, {"peak": ("max", F.col("equity"))}, bucket)
    d = d.withColumn("won", F.when(F.col("side") == "sell", (F.col(price) > F.col("__entry")).cast("int")))
    return d.drop("__held", "__before", "__factor", "__entry")


def trades(tested: DataFrame, by: Sequence[str] = BY, price="close") -> DataFrame:
    return tested.where("side IS NOT NULL").select(*by, "ts", F.col(price).alias("price"), "side")


def figures(g: DataFrame, capital: float, per_year: int = 252) -> DataFrame:
    """Figures of a group from its row count ``__n``, final equity, and mean ``__m`` and spread ``__s`` of returns."""
    g = g.withColumn("total_return", F.col("final_equity") / capital - 1)
    return g.withColumns(
        {
            "annual_return": F.pow(1 + F.col("total_return"), per_year / F.col("__n")) - 1,
            "annual_return_from_mean": F.pow(1 + F.col("__m"), F.lit(float(per_year))) - 1,
            "sharpe": F.coalesce(ratio(F.col("__m"), F.col("__s")) * math.sqrt(per_year), F.lit(0.0)),
            "volatility": F.col("__s") * math.sqrt(per_year),
        }
    ).drop("__n", "__m", "__s")


def backtest_metrics(tested: DataFrame, by: Sequence[str] = BY, capital: float = 1000.0, per_year: int = 252) -> DataFrame:
    """Return, Sharpe, drawdown, volatility, win rate, trades and final equity per group."""
    g = tested.groupBy(*by).agg(
        F.count("*").alias("__n"), F.max_by("equity", "ts").alias("final_equity"), F.avg("ret").alias("__m"), F.stddev_samp("ret").alias("__s"),
        F.min(F.col("equity") / F.col("peak") - 1).alias("max_drawdown"),
        F.coalesce(F.avg(F.col("won").cast("double")), F.lit(0.0)).alias("win_rate"), F.count("side").alias("num_trades"),
    )
    return figures(g, capital, per_year)


def buy_hold_benchmark(df: DataFrame, by: Sequence[str] = BY, price="close", capital: float = 1000.0, per_year: int = 252) -> DataFrame:
    """The same figures for holding from the first to the last row without fees."""
    w = series_window(by)
    d = df.withColumns({"ret": F.coalesce(pct_change(F.col(price), w), F.lit(0.0)), "peak": F.max(price).over(so_far(w))})
    g = d.groupBy(*by).agg(
        F.count("*").alias("__n"), F.min_by(price, "ts").alias("__a"), F.max_by(price, "ts").alias("__z"), F.avg("ret").alias("__m"),
        F.stddev_samp("ret").alias("__s"), F.min(F.col(price) / F.col("peak") - 1).alias("max_drawdown"),
    )
    g = g.withColumn("total_return", F.col("__z") / F.col("__a") - 1)
    return g.withColumns(
        {
            "final_equity": capital * (1 + F.col("total_return")),
            "annual_return": F.pow(1 + F.col("total_return"), per_year / F.col("__n")) - 1,
            "sharpe": F.coalesce(ratio(F.col("__m"), F.col("__s")) * math.sqrt(per_year), F.lit(0.0)),
            "volatility": F.col("__s") * math.sqrt(per_year),
            "win_rate": F.when(F.col("total_return") > 0, 1.0).otherwise(0.0),
            "num_trades": F.lit(1).cast("bigint"),
        }
    ).drop("__n", "__a", "__z", "__m", "__s")


def backtests(df: DataFrame, signals: dict[str, Column], fees: Sequence[float], by: Sequence[str] = BY, price="close", capital: float = 1000.0, name="strategy") -> DataFrame:
    """``backtest_metrics`` of several signals on the same rows: one result row per group, signal (``name``) and ``fee``.

    Signals are columns side by side, and so are fees, until the figures are finished: rows are sorted once, as narrow as
    they come, and never copied. A fee changes no signal: the equity is the growth of the held position times (1 - fee)
    to the number of trades so far.
    """
    w, ids = series_window(by), range(len(signals))
    here, col = so_far(w), F.col
    d = df.select(*by, "ts", col(price).alias("__price"), *[F.when(s != 0, s).alias(f"__s{i}") for i, s in enumerate(signals.values())])
    first = {"__before": ("last", col("__price"), True)}
    for i in ids:
        first |= {f"__state{i}": ("last", col(f"__s{i}")), f"__held{i}": ("last", col(f"__s{i}"), True)}
    d = running(d, by, ["ts"], first).drop(*[f"__s{i}" for i in ids])
    moves = {}
    for i in ids:
        state, held = F.coalesce(f"__state{i}", F.lit(-1)), F.coalesce(f"__held{i}", F.lit(-1))
        moves |= {
            f"__growth{i}": F.when(held == 1, col("__price") / col("__before")).otherwise(F.lit(1.0)),
            f"__trade{i}": (state != held).cast("int"), f"__sells{i}": (state != held) & (state != 1),
        }
    d = d.withColumns(moves).drop(*[f"__{x}{i}" for x in ("state", "held") for i in ids])
    second = {}
    for i in ids:
        second |= {f"__entry{i}": ("last", F.when(col(f"__trade{i}") == 1, col("__price")), True), f"__trades{i}": ("sum", col(f"__trade{i}"))}
    d = running(d, by, ["ts"], second).withColumns({f"__grown{i}": F.product(f"__growth{i}").over(here) for i in ids})
    pairs = [(i, j, float(f)) for i in ids for j, f in enumerate(fees)]
    d = d.withColumns({f"__e{i}_{j}": capital * col(f"__grown{i}") * F.pow(F.lit(1.0 - f), col(f"__trades{i}").cast("double")) for i, j, f in pairs})
    d = d.drop(*[f"__{x}{i}" for x in ("grown", "trades") for i in ids])
    d = d.withColumns({f"__peak{i}_{j}": F.max(f"__e{i}_{j}").over(here) for i, j, _ in pairs})
    won = lambda i: F.when(col(f"__sells{i}"), (col("__price") > col(f"__entry{i}")).cast("double"))
    ret = lambda i, f: F.when(col("__before").isNull(), 0.0).otherwise(col(f"__growth{i}") * F.when(col(f"__trade{i}") == 1, 1.0 - f).otherwise(1.0) - 1)
    aggs = []
    for i in ids:
        aggs += [F.coalesce(F.avg(won(i)), F.lit(0.0)).alias(f"__w{i}"), F.sum(f"__trade{i}").cast("bigint").alias(f"__t{i}")]
    for i, j, f in pairs:
        aggs.append(F.struct(
            F.max_by(f"__e{i}_{j}", "ts").alias("final_equity"), F.avg(ret(i, f)).alias("__m"), F.stddev_samp(ret(i, f)).alias("__s"),
            F.min(col(f"__e{i}_{j}") / col(f"__peak{i}_{j}") - 1).alias("max_drawdown"),
        ).alias(f"__f{i}_{j}"))
    g = d.groupBy(*by).agg(F.count("*").alias("__n"), *aggs)
    rows = [F.struct(F.lit(n).alias(name), F.lit(f).alias("fee"), col(f"__w{i}").alias("win_rate"), col(f"__t{i}").alias("num_trades"), col(f"__f{i}_{j}").alias("__f"))
            for (i, j, f) in pairs for n in [list(signals)[i]]]
    g = g.select(*by, "__n", F.explode(F.array(*rows)).alias("__r")).select(*by, "__n", "__r.*").select("*", "__f.*").drop("__f")
    return figures(g, capital)


def sweep(df: DataFrame, confidences: Sequence[float], fees: Sequence[float], changes: Sequence[float], by: Sequence[str] = BY, price="close", capital: float = 1000.0) -> DataFrame:
    """Directional strategy over all parameter combinations, one result row each.

    All are run side by side (``backtests``). ``change`` does not enter this signal; its values copy finished rows.
    """
    w = series_window(by)
    d = df.withColumn("__p", _filled("predicted", w))
    d = d.withColumns({"__move": pct_change(F.col("__p"), w)}).drop("__p")
    signals = {float(c): F.coalesce(_sign_beyond(F.col("__move"), float(c)), F.lit(0)) for c in confidences}
    g = backtests(d, signals, fees, by, price, capital, "confidence")
    return g.withColumn("change", F.explode(F.array(*[F.lit(float(c)) for c in changes])))


def top_k_sweep(results: DataFrame, k: int = 10, ties: Sequence[str] = ("model", "series_key", "confidence", "fee", "change"), digits: int = 9) -> DataFrame:
    """Best k by return, by Sharpe and by (return / |drawdown|) * Sharpe; ties by parameters.

    Scores are rounded first: equal combinations differ in the last bits. Three rankings read them, so they are
    written once instead of running the sweep for each.
    """
    combined = ratio(F.col("total_return"), F.abs("max_drawdown")) * F.col("sharpe")
    by = {"return": F.col("total_return"), "sharpe": F.col("sharpe"), "combined": combined}
    scores = written(results.select("*", *[F.round(x, digits).alias(f"__{n}") for n, x in by.items()]), "sweep")
    out = None
    for ranking in by:
        top = scores.withColumns({"score": F.col(f"__{ranking}"), "ranking": F.lit(ranking)}).drop(*[f"__{n}" for n in by]).orderBy(F.desc_nulls_last("score"), *ties).limit(k)
        out = top if out is None else out.unionByName(top)
    return out


def sweep_beats(results: DataFrame, min_return: float, min_sharpe: float) -> DataFrame:
    return results.where((F.col("total_return") > min_return) & (F.col("sharpe") > min_sharpe))


def param_sensitivity(results: DataFrame, params: Sequence[str], metrics=("total_return", "sharpe")) -> DataFrame:
    """Mean, spread and best of each metric per value of each parameter: one grouped pass."""
    rows = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("setting")) for p in params])
    long = results.withColumn("__r", F.explode(rows)).select("*", "__r.*")
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}"), F.max(m).alias(f"max_{m}")]
    return long.groupBy("param", "setting").agg(*aggs)


# --- leaderboards --------------------------------------------------------------------------

def model_leaderboard(results: DataFrame, by: str = "model") -> DataFrame:
    """Mean figures per model, four decimals, best mean return first."""
    g = results.groupBy(by).agg(*[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in ("total_return", "sharpe", "max_drawdown", "win_rate")])
    return g.orderBy(F.desc("avg_total_return"), by)


def strategy_stats(results: DataFrame, metric: str = "total_return") -> DataFrame:
    return results.groupBy("strategy").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.max(metric).alias("max"), F.min(metric).alias("min"))


def metric_pivot(results: DataFrame, strategies: Sequence[str], metric: str = "total_return") -> DataFrame:
    """Models by strategies; the explicit value list saves the pass that would look for it."""
    return results.groupBy("model").pivot("strategy", list(strategies)).agg(F.avg(metric))


def best_per_strategy(results: DataFrame, metric: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc(metric), "model", "series_key"))
    return results.withColumn("__k", best).where("__k = 1").select("strategy", "model", "series_key", metric)


def beat_benchmark(results: DataFrame, benchmark: DataFrame, high: float = 5.0, by: Sequence[str] = ("series_key",)) -> DataFrame:
    """Rows above buy and hold and rows above a high return, as count and share per strategy."""
    b = benchmark.select(*by, F.col("total_return").alias("__hold"))
    d = results.join(b, list(by))
    beats = F.when(F.col("total_return") > F.col("__hold"), 1.0).otherwise(0.0)
    return d.groupBy("strategy").agg(
        F.count("*").alias("n"), F.sum(beats).cast("bigint").alias("n_beats"), F.avg(beats).alias("share_beats"),
        F.count(F.when(F.col("total_return") > high, 1)).alias("n_high"),
    )


def shift_prediction_time(df: DataFrame, horizon: int, by: Sequence[str] = BY, price="close", prediction="predicted") -> DataFrame:
    """Prediction time = row time + mean cadence * horizon; a missing prediction is the close."""
    w = series_window(by)
    step = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
    cadence = df.withColumn("__step", step).groupBy(*by).agg(F.avg("__step").alias("__c"))
    d = df.join(cadence, list(by))
    return d.withColumns(
        {"prediction_ts": F.floor(F.unix_timestamp("ts") + F.col("__c") * horizon), prediction: F.coalesce(prediction, price)}
    ).drop("__c")
