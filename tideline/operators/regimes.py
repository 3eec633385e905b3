"""Market regimes, context labels and text rows made from them."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.rolling import pct_change, series_window
from tideline.operators.splits import tail_rows

KEYS = ("series_key",)


def _three_way(x: Column, up: float, names=("bull", "bear", "sideways")) -> Column:
    return F.when(x > up, names[0]).when(x < -up, names[1]).otherwise(names[2])


def regime_rolling(df: DataFrame, window: int = 30, low: float = 0.02, high: float = 0.05, keys: Sequence[str] = KEYS, price: str = "close") -> DataFrame:
    """Label of every row from the ``window`` returns before its own return.

    Nine labels; the trend threshold depends on the volatility. The rows without enough
    history take the first label of their series.
    """
    w = series_window(keys)
    d = df.withColumns({"__r": pct_change(F.col(price), w), "__i": F.row_number().over(w)})
    f = w.rowsBetween(-window, -1)
    full = F.count("__r").over(f) == window
    d = d.withColumns({"__m": F.when(full, F.avg("__r").over(f)), "__v": F.when(full, F.stddev_pop("__r").over(f))})
    m, v = F.col("__m"), F.col("__v")
    label = (
        F.when(v < low, F.concat(_three_way(m, 0.001), F.lit("_low_vol")))
        .when(v > high, F.concat(_three_way(m, 0.0), F.lit("_high_vol")))
        .when(v.isNotNull(), F.concat(_three_way(m, 0.0005), F.lit("_med_vol")))
    )
    d = d.withColumn("regime", label)
    first = F.max(F.when(F.col("__i") == window + 2, F.col("regime"))).over(Window.partitionBy(*keys))
    return d.withColumn("regime", F.coalesce("regime", first)).drop("__r", "__i", "__m", "__v")


def regime_stats(labelled: DataFrame, keys: Sequence[str] = KEYS, price: str = "close") -> DataFrame:
    """Count, mean, spread and Sharpe of the return to the next row; the last row of a regime has none."""
    w = series_window(keys)
    d = labelled.withColumns({"__next": F.lead(price).over(w) / F.col(price) - 1})
    last = d.groupBy(*keys, "regime").agg(F.max("ts").alias("__last"))
    d = d.join(last, [*keys, "regime"])
    r = F.when(F.col("ts") < F.col("__last"), F.col("__next"))
    g = d.groupBy(*keys, "regime").agg(F.count("*").alias("n"), F.avg(r).alias("avg_return"), F.stddev_pop(r).alias("volatility")).where("n > 1")
    return g.withColumn("sharpe_ratio", F.col("avg_return") / (F.col("volatility") + 1e-8))


def latest_labels(df: DataFrame, window: int = 30, keys: Sequence[str] = KEYS, price: str = "close") -> DataFrame:
    """Current regime (3 x 3 labels from the last ``window`` returns) and trend (last 10 rows) per series."""
    w = series_window(keys)
    tail = tail_rows(df.select(*keys, "ts", price), max(window + 1, 10), keys)
    d = tail.withColumn("__r", pct_change(F.col(price), w))
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"))))
    x = F.col(price)
    g = d.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.avg(F.when(F.col("__k") <= window, F.col("__r"))).alias("__m"), F.stddev_pop(F.when(F.col("__k") <= window, F.col("__r"))).alias("__v"),
        F.max(F.when(F.col("__k") == 1, x)).alias("__last"), F.max(F.when(F.col("__k") == 10, x)).alias("__ten"),
    )
    vol = F.when(F.col("__v") < 0.015, "low_vol").when(F.col("__v") > 0.04, "high_vol").otherwise("med_vol")
    move = (F.col("__last") - F.col("__ten")) / F.col("__ten")
    return g.select(
        *keys,
        F.when(F.col("__n") < window, "unknown").otherwise(F.concat_ws("_", _three_way(F.col("__m"), 0.001), vol)).alias("regime"),
        F.when(F.col("__n") < 10, "neutral").otherwise(_three_way(move, 0.02, ("upward", "downward", "neutral"))).alias("trend_direction"),
    )


def volatility_level(df: DataFrame, keys: Sequence[str] = KEYS, price: str = "close") -> DataFrame:
    """low, medium or high from the spread of all returns of the series."""
    d = df.withColumn("__r", pct_change(F.col(price), series_window(keys)))
    g = d.groupBy(*keys).agg(F.count("*").alias("__n"), F.stddev_pop("__r").alias("__v"))
    label = F.when(F.col("__n") < 10, "medium").when(F.col("__v") < 0.015, "low").when(F.col("__v") > 0.04, "high").otherwise("medium")
    return g.select(*keys, label.alias("volatility_level"))


# --- labels of one row -------------------------------------------------------------------------

def session_label(hour: Column) -> Column:
    return F.when(hour < 8, "asian_session").when(hour < 16, "european_session").otherwise("us_session")


def day_label(weekday: Column) -> Column:
    return F.when(weekday >= 5, "weekend").when(weekday == 0, "monday").when(weekday == 4, "friday").otherwise("weekday")


def macro_label(rate: Column, risk: Column) -> Column:
    return F.when((risk > 2) & (rate < 3), "bullish").when((risk < -2) | (rate > 6), "bearish").otherwise("neutral")


def onchain_label(momentum: Column, flow: Column) -> Column:
    return F.when((momentum > 0) & (flow < 0), "strong").when((momentum < 0) & (flow > 0), "weak").otherwise("moderate")


def _buckets(x: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    out = None
    for c, n in zip(cuts, names):
        out = F.when(x < c, n) if out is None else out.when(x < c, n)
    return out.otherwise(names[-1])


def sentiment_label(score: Column) -> Column:
    return _buckets(score, (0.2, 0.4, 0.6, 0.8), ("extremely bearish", "bearish", "neutral", "bullish", "extremely bullish"))


def fear_greed_label(index: Column) -> Column:
    return _buckets(index, (25, 45, 55, 75), ("extreme fear", "fear", "neutral", "greed", "extreme greed"))


def market_context(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One struct per row: momentum, moods, environment and time labels.

    Expects ``close, sentiment_score, fear_greed_index, rate, risk, momentum, flow``.
    """
    w = series_window(keys)
    context = F.struct(
        pct_change(F.col("close"), w).alias("price_momentum"),
        F.coalesce("sentiment_score", F.lit(0.5)).alias("sentiment_score"),
        F.coalesce(F.col("fear_greed_index").cast("int"), F.lit(50)).alias("fear_greed_index"),
        macro_label(F.coalesce("rate", F.lit(5.0)), F.coalesce("risk", F.lit(0.0))).alias("macro_environment"),
        onchain_label(F.coalesce("momentum", F.lit(0.0)), F.coalesce("flow", F.lit(0.0))).alias("onchain_strength"),
        session_label(F.hour("ts")).alias("time_of_day"),
        day_label(F.weekday("ts")).alias("day_of_week"),
    )
    return df.withColumn("context", context)


# --- text ------------------------------------------------------------------------------------

def autocorr_top_lags(df: DataFrame, column: str, k: int = 5, digits: int = 6) -> DataFrame:
    """Lags with the largest circular autocorrelation of each array, by FFT in Arrow batches.

    Equal values (lag j and T - j always are) rank by lag; ``top_lags`` holds (lag, value).
    """
    kind = T.ArrayType(T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("value", T.DoubleType())]))

    @F.pandas_udf(kind)
    def top(arrays: pd.Series) -> pd.Series:
        out = []
        for x in arrays:
            x = np.asarray(x, dtype=float)
            f = np.fft.rfft(x)
            r = np.fft.irfft(f * np.conj(f), n=len(x))
            r[1:] = (r[1:] + r[:0:-1]) / 2  # lags j and T - j are equal, but not in their last bits
            r = np.round(r, digits)
            order = np.lexsort((np.arange(len(r)), -r))[:k]
            out.append([{"lag": int(i), "value": float(r[i])} for i in order])
        return pd.Series(out)

    return df.withColumn("top_lags", top(column))


def lower_median(a: Column) -> Column:
    """Middle value of an array, the lower one of two."""
    s = F.array_sort(a)
    return F.element_at(s, F.floor((F.size(a) + 1) / 2).cast("int"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """``template`` with every ``{name}`` replaced by its column as text."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if i % 2 == 0 else values[x].cast("string") for i, x in enumerate(parts)])


WINDOW_TEMPLATE = (
    "{about} The last {steps} values run from {low} to {high}, half of them at or below {median}; they end {trend} where they began "
    "and resemble themselves most after {lags} steps. Continue the series for {horizon} steps."
)


def window_prompt(df: DataFrame, column: str, about: str, horizon: int, k: int = 5, template: str = WINDOW_TEMPLATE) -> DataFrame:
    """Text row of a window: its statistics filled into ``template``.

    Placeholders: about, steps, horizon, low, high, median, trend (above or below), lags.
    Values are cut to two decimals.
    """
    a = F.col(column)
    rising = F.element_at(a, -1) - F.element_at(a, 1) > 0
    money = lambda x: (F.floor(x * 100) / 100).cast("decimal(18,2)")
    text = filled(template, {
        "about": F.lit(about), "horizon": F.lit(horizon), "steps": F.size(a), "low": money(F.array_min(a)), "high": money(F.array_max(a)),
        "median": money(lower_median(a)), "trend": F.when(rising, "above").otherwise("below"),
        "lags": F.array_join(F.transform("top_lags", lambda x: x.getField("lag").cast("string")), ", "),
    })
    d = autocorr_top_lags(df, column, k, digits=2)  # sums of products of prices are exact to about that
    return d.withColumns({"trend": F.when(rising, "upward").otherwise("downward"), "median": lower_median(a), "prompt": text})


# Default phrases per kind of label; pass other tables to ``context_prompt`` to use your own.
PHRASES = {
    "regime": {
        "bull_low_vol": "climbs calmly", "bull_med_vol": "climbs", "bull_high_vol": "climbs in leaps", "bear_low_vol": "slides calmly", "bear_med_vol": "slides",
        "bear_high_vol": "drops in leaps", "sideways_low_vol": "stands still", "sideways_med_vol": "moves within a band", "sideways_high_vol": "swings without aim",
        "unknown": "has too short a past to tell",
    },
    "volatility_level": {"low": "returns vary little", "medium": "returns vary as usual", "high": "returns vary a lot"},
    "style": {
        "scalping": "positions of minutes", "day_trading": "positions closed by the evening", "swing_trading": "positions of days", "position_trading": "positions of months",
        "volatility_trading": "bets on the size of moves", "momentum_trading": "bets on moves that go on", "mean_reversion": "bets on moves that turn back",
        "breakout_trading": "bets on leaving a band",
    },
    "source": {
        "sentiment_driven": "opinions", "macro_influenced": "rates and stock prices", "onchain_focused": "network figures", "multi_source": "all sources at once",
        "correlation_aware": "other assets", "event_driven": "announced events",
    },
    "macro_environment": {"bullish": "rates help", "bearish": "rates weigh", "neutral": "rates do neither"},
    "onchain_strength": {"strong": "the network grows", "weak": "the network shrinks", "moderate": "the network is steady"},
    "time_of_day": {"asian_session": "night", "european_session": "morning", "us_session": "afternoon"},
    "day_of_week": {"monday": "start of the week", "friday": "end of the week", "weekend": "weekend", "weekday": "middle of the week"},
}
REACH = ((6, "the latest moves"), (24, "pattern and regime alike"), (None, "changes of regime"))
CONTEXT_TEMPLATE = (
    "Wanted: the next {horizon} steps, for {style}, seen through {source}; look at {reach}. The series {regime} and {volatility_level}. "
    "Around it {macro_environment}, {onchain_strength}, opinion is {sentiment} and the mood {fear_greed}. Clock: {time_of_day}, {day_of_week}."
)


def reach(horizon: int) -> str:
    return next(text for most, text in REACH if most is None or horizon <= most)


def looked_up(phrases: dict[str, str], label: Column) -> Column:
    """The phrase of a label, or the label itself without underscores."""
    table = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    return F.coalesce(F.element_at(table, label), F.translate(label, "_", " "), F.lit("unknown"))


def context_prompt(df: DataFrame, horizon: int, style: str = "swing_trading", source: str = "multi_source", phrases: dict[str, dict[str, str]] | None = None,
                   template: str = CONTEXT_TEMPLATE) -> DataFrame:
    """Prompt per row from ``regime, volatility_level, context``: phrases looked up by label, filled into ``template``."""
    tables, c = PHRASES | (phrases or {}), F.col("context")
    labels = {"regime": F.col("regime"), "volatility_level": F.col("volatility_level"), "style": F.lit(style), "source": F.lit(source)}
    labels |= {k: c[k] for k in ("macro_environment", "onchain_strength", "time_of_day", "day_of_week")}
    values = {k: looked_up(tables[k], x) for k, x in labels.items()}
    values |= {"horizon": F.lit(horizon), "reach": F.lit(reach(horizon)), "sentiment": sentiment_label(c["sentiment_score"]), "fear_greed": fear_greed_label(c["fear_greed_index"])}
    return df.withColumn("prompt", filled(template, values))


def prompt_performance(scores: DataFrame, key: str, metric: str, k: int = 5) -> DataFrame:
    """The k prompt keys with the lowest mean metric."""
    g = scores.groupBy(key).agg(F.avg(metric).alias("mean_metric"))
    return g.orderBy(F.asc(F.round("mean_metric", 9)), key).limit(k)


def window_arrays(df: DataFrame, column: str, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Last n values of each series as one array (n is a window length, not a series length)."""
    t = tail_rows(df.select(*keys, "ts", column), n, keys)
    g = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", column))).alias("__w"))
    return g.select(*keys, F.transform("__w", lambda s: s.getField(column)).alias("values"))


