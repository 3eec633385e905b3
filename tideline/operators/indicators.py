"""Technical, volatility and volume features of bar series.

A feature is stated in three steps: ``prepare`` (values of a row and its predecessors),
``roll`` (aggregates over the last n rows) and ``finish`` (what is made of them).
``add_features`` merges the steps of any number of features, so a whole feature table costs
one exchange and one sort, shared frames are evaluated once, and every frame length is
walked once per row. With a longer ``keys`` (a chunk column, see ``ordered.over_chunks``)
the same code runs on pieces of a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.nulls import flag, ratio
from tideline.functions.rolling import (
    add_ema, change, last_rows, log_return, pct_change, rolling, series_window, sma, strength,
)
from tideline.operators.ordered import over_chunks, running, time_bucket
from tideline.session import written

KEYS = ("series_key",)
Expr = Callable[[WindowSpec], Column]


def c(name: str) -> Column:
    return F.col(name)


@dataclass
class Feature:
    """Columns by step; names with a leading underscore are helpers and dropped."""

    prepare: dict[str, Expr] = field(default_factory=dict)
    roll: dict[str, Expr] = field(default_factory=dict)
    finish: dict[str, Expr] = field(default_factory=dict)
    smooth: dict[str, Expr] = field(default_factory=dict)


def add_features(df: DataFrame, features: Sequence[Feature], keys: Sequence[str] = KEYS, order=("ts",)) -> DataFrame:
    w = series_window(keys, order)
    for step in ("prepare", "roll", "finish", "smooth"):
        merged: dict[str, Expr] = {}
        for f in features:
            merged.update(getattr(f, step))
        if merged:
            df = df.withColumns({n: x(w) for n, x in merged.items() if n not in df.columns})
    return df.drop(*[n for n in df.columns if n.startswith("_") and not n.startswith("__")])


def _mean(x: str | Column, n: int) -> Expr:
    x = c(x) if isinstance(x, str) else x
    return lambda w: sma(x, n, w)


def _roll(agg, x: str | Column, n: int) -> Expr:
    x = c(x) if isinstance(x, str) else x
    return lambda w: rolling(agg, x, n, w)


def _row(x: Column) -> Expr:
    return lambda w: x


# --- features ----------------------------------------------------------------------------

def moving_average_features(sizes=(5, 10, 20, 50)) -> Feature:
    return Feature(roll={f"sma_{n}": _mean("close", n) for n in sizes})


def rsi_features(sizes=(14, 30)) -> Feature:
    """Relative strength from simple means; the first row counts as no change."""
    d = {"_step": lambda w: F.coalesce(change(c("close"), w), F.lit(0.0))}
    up, down = F.greatest(c("_step"), F.lit(0.0)), F.greatest(-c("_step"), F.lit(0.0))
    return Feature(
        d,
        {f"_up{n}": _mean(up, n) for n in sizes} | {f"_down{n}": _mean(down, n) for n in sizes},
        {f"rsi_{n}": _row(strength(c(f"_up{n}"), c(f"_down{n}"))) for n in sizes},
    )


def bollinger_features(n=20, k=2.0, relative_width=True) -> Feature:
    mid, sd = c(f"_mean{n}"), c(f"_std{n}")
    upper, lower = mid + sd * k, mid - sd * k
    return Feature(
        roll={f"_mean{n}": _mean("close", n), f"_std{n}": _roll(F.stddev_samp, "close", n)},
        finish={
            "bb_upper": _row(upper), "bb_middle": _row(mid), "bb_lower": _row(lower),
            "bb_width": _row(ratio(upper - lower, mid) if relative_width else upper - lower),
            "bb_position": _row(ratio(c("close") - lower, upper - lower)),
        },
    )


def _range_frames(n: int) -> dict[str, Expr]:
    return {f"_top{n}": _roll(F.max, "high", n), f"_bottom{n}": _roll(F.min, "low", n)}


def stochastic_features(n=14, smooth=3) -> Feature:
    k = 100 * ratio(c("close") - c(f"_bottom{n}"), c(f"_top{n}") - c(f"_bottom{n}"))
    return Feature(
        roll=_range_frames(n), finish={"stoch_k": _row(k)}, smooth={"stoch_d": _mean("stoch_k", smooth)}
    )


def williams_features(n=14) -> Feature:
    r = -100 * ratio(c(f"_top{n}") - c("close"), c(f"_top{n}") - c(f"_bottom{n}"))
    return Feature(roll=_range_frames(n), finish={"williams_r": _row(r)})


def atr_features(n=14) -> Feature:
    """Mean true range; the first row has no earlier close and uses high - low."""

    def true_range(w):
        before = F.lag("close").over(w)
        return F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))

    return Feature({"_true_range": true_range}, {"atr": _mean("_true_range", n)})


_RETURNS: dict[str, Expr] = {
    "returns": lambda w: pct_change(c("close"), w),
    "log_returns": lambda w: log_return(c("close"), w),
}


def return_features() -> Feature:
    return Feature(_RETURNS)


def realized_vol_features(sizes=(10, 30), per_year=252) -> Feature:
    return Feature(
        _RETURNS,
        {f"realized_vol_{n}": lambda w, n=n: rolling(F.stddev_samp, c("returns"), n, w) * math.sqrt(per_year) for n in sizes},
    )


def garch_features(n=100, per_year=252) -> Feature:
    """Rolling variance of returns, annualised: a simple stand-in for a fitted model."""
    return Feature(_RETURNS, {"garch_vol": lambda w: F.sqrt(rolling(F.var_samp, c("returns"), n, w) * per_year)})


def parkinson_features(n=30, per_year=252) -> Feature:
    x = F.pow(F.ln(ratio(c("high"), c("low"))), F.lit(2.0)) / (4 * math.log(2))
    return Feature({"_park": _row(x)}, {"parkinson_vol": lambda w: F.sqrt(sma(c("_park"), n, w) * per_year)})


def garman_klass_features(n=30, per_year=252) -> Feature:
    hl, co = F.ln(ratio(c("high"), c("low"))), F.ln(ratio(c("close"), c("open")))
    return Feature(
        {"_gk": _row(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co)},
        {"_gk_mean": lambda w: sma(c("_gk"), n, w) * per_year},
        {"garman_klass_vol": _row(F.when(c("_gk_mean") >= 0, F.sqrt("_gk_mean")))},
    )


def price_impact_features(n=20) -> Feature:
    return Feature(
        _RETURNS, {f"_vol_mean{n}": _mean("volume", n)},
        {"price_impact": _row(F.abs(c("returns")) / (c(f"_vol_mean{n}") + 1e-8))},
    )


def _typical() -> Column:
    return (c("high") + c("low") + c("close")) / 3



def vwap_features(n=20) -> Feature:
    return Feature(
        {},
        {f"_pv{n}": _roll(F.sum, _typical() * c("volume"), n), f"_v{n}": _roll(F.sum, "volume", n)},
        {"vwap": _row(ratio(c(f"_pv{n}"), c(f"_v{n}")))},
    )


def mfi_features(n=14) -> Feature:
    """Money flow index; the first row counts as neither inflow nor outflow."""
    t = _typical()
    flow = t * c("volume")
    gain = F.when(c("_flow_step") > 0, flow).otherwise(0.0)
    loss = F.when(c("_flow_step") < 0, flow).otherwise(0.0)
    return Feature(
        {"_flow_step": lambda w: F.coalesce(change(t, w), F.lit(0.0))},
        {f"_gain{n}": _roll(F.sum, gain, n), f"_loss{n}": _roll(F.sum, loss, n)},
        {"mfi": _row(strength(c(f"_gain{n}"), c(f"_loss{n}")))},
    )


def volume_ratio_features(n=10) -> Feature:
    return Feature(
        roll={"volume_sma": _mean("volume", n)}, finish={"volume_ratio": _row(ratio(c("volume"), c("volume_sma")))}
    )


def lag_features(columns=("close", "volume", "high", "low"), steps=(1, 2, 3, 5, 10), name="{c}_lag_{n}") -> Feature:
    return Feature(
        {name.format(c=x, n=n): lambda w, x=x, n=n: F.lag(x, n).over(w) for x in columns for n in steps}
    )


def candle_features() -> Feature:
    body_top, body_bottom = F.greatest("open", "close"), F.least("open", "close")
    return Feature(
        {
            "high_low_ratio": _row(ratio(c("high"), c("low"))),
            "open_close_ratio": _row(ratio(c("open"), c("close"))),
            "price_range": _row(c("high") - c("low")),
            "body_size": _row(F.abs(c("close") - c("open"))),
            "upper_shadow": _row(c("high") - body_top),
            "lower_shadow": _row(body_bottom - c("low")),
        }
    )


def pattern_features() -> Feature:
    body = F.abs(c("close") - c("open"))
    upper = c("high") - F.greatest("open", "close")
    lower = F.least("open", "close") - c("low")
    return Feature(
        {
            "doji": _row(flag(body <= 0.1 * (c("high") - c("low")))),
            "hammer": _row(flag((lower > 2 * body) & (upper < body))),
        }
    )


def dispersion_features(n=10) -> Feature:
    return Feature(roll={f"{x}_std_{n}": _roll(F.stddev_samp, x, n) for x in ("close", "volume")})


def momentum_features(sizes=(5, 10, 14)) -> Feature:
    out: dict[str, Expr] = {}
    for n in sizes:
        out[f"momentum_{n}"] = lambda w, n=n: ratio(c("close"), F.lag("close", n).over(w))
        out[f"roc_{n}"] = lambda w, n=n: (ratio(c("close"), F.lag("close", n).over(w)) - 1) * 100
    return Feature(out)


def volume_price_trend_features() -> Feature:
    return Feature({"volume_price_trend": lambda w: c("volume") * pct_change(c("close"), w)})


def trend_flag_features() -> Feature:
    return Feature(
        roll={f"sma_{n}": _mean("close", n) for n in (20, 50)},
        finish={
            "above_sma_20": _row(flag(c("close") > c("sma_20"))),
            "above_sma_50": _row(flag(c("close") > c("sma_50"))),
            "sma_20_above_50": _row(flag(c("sma_20") > c("sma_50"))),
        },
    )


def ratio_to_mean_features(n=20) -> Feature:
    return Feature(
        roll={f"_vol_mean{n}": _mean("volume", n), f"_mean{n}": _mean("close", n)},
        finish={
            "volume_to_sma": _row(ratio(c("volume"), c(f"_vol_mean{n}"))),
            "price_to_sma": _row(ratio(c("close"), c(f"_mean{n}"))),
        },
    )


def calendar_features() -> Feature:
    """Hour, weekday (Monday 0), day, month, quarter and circular encodings."""
    hour, dow, tau = F.hour("ts"), F.weekday("ts"), 2 * math.pi
    return Feature(
        {
            "hour": _row(hour), "day_of_week": _row(dow), "day_of_month": _row(F.dayofmonth("ts")),
            "month": _row(F.month("ts")), "quarter": _row(F.quarter("ts")),
            "hour_sin": _row(F.sin(tau * hour / 24)), "hour_cos": _row(F.cos(tau * hour / 24)),
            "dow_sin": _row(F.sin(tau * dow / 7)), "dow_cos": _row(F.cos(tau * dow / 7)),
        }
    )


def enhance_features(n=24) -> Feature:
    return Feature(
        {
            "price_lag_1": lambda w: F.lag("close").over(w),
            "price_change": lambda w: pct_change(c("close"), w),
            "hour": _row(F.hour("ts")), "day_of_week": _row(F.weekday("ts")),
            "month": _row(F.month("ts")), "quarter": _row(F.quarter("ts")),
        },
        {"price_volatility": _roll(F.stddev_samp, "close", n)},
    )


def slope_features(n=10, column="close") -> Feature:
    """How fast a value falls: -(last - first)/(n-1)/mean over n rows, within [-1, 1]."""

    def slope(w):
        f = last_rows(w, n)
        s = -ratio((c(column) - F.first(column).over(f)) / (n - 1), F.avg(column).over(f))
        return F.when(F.count(column).over(f) == n, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))

    return Feature(roll={"normalised_slope": slope})


# --- exponential means, cumulative values --------------------------------------------------

def exponential_averages(df: DataFrame, keys: Sequence[str] = KEYS, spans=(5, 10, 20)) -> DataFrame:
    return add_ema(df, {f"ema_{n}": (c("close"), n) for n in spans}, keys)


def macd(df: DataFrame, keys: Sequence[str] = KEYS, fast=12, slow=26, signal=9, emas: dict[str, int] | None = None) -> DataFrame:
    """Difference of two exponential means and its own mean; ``emas`` adds further plain ones."""
    first = {"_fast": (c("close"), fast), "_slow": (c("close"), slow)}
    first |= {n: (c("close"), s) for n, s in (emas or {}).items()}
    d = add_ema(df, first, keys, keep_blocks=True)
    d = d.withColumn("macd", c("_fast") - c("_slow")).drop("_fast", "_slow")
    d = add_ema(d, {"macd_signal": (c("macd"), signal)}, keys, block_rows=_block(first))
    return d.withColumn("macd_histogram", c("macd") - c("macd_signal"))


def _block(columns) -> int:
    from tideline.functions.rolling import ema_block_rows

    return ema_block_rows([s for _, s in columns.values()])


def obv(df: DataFrame, keys: Sequence[str] = KEYS, bucket: Column | None = None) -> DataFrame:
    """On-balance volume: signed volume accumulated; the first row adds nothing."""
    d = running(df, keys, ["ts"], {"__before": ("last", c("close"), True)}, bucket)
    d = d if bucket is None else written(d)
    signed = F.coalesce(F.signum(c("close") - c("__before")), F.lit(0.0)) * c("volume")
    d = d.withColumn("__sv", signed)
    return running(d, keys, ["ts"], {"obv": ("sum", c("__sv"))}, bucket).drop("__sv", "__before")


# Rows of history that determine every feature of a row: two blocks of the slowest
# exponential mean (span 26) or the longest frame plus one, whichever is larger.
FEATURE_LOOKBACK = 2 * 520 + 101


def all_features(df: DataFrame, keys: Sequence[str] = KEYS, drop_incomplete: bool = True) -> DataFrame:
    """The full feature table: 6 bar columns and 62 derived ones, incomplete rows dropped.

    Unused features cost nothing: a later ``select`` prunes their window expressions. Exponential means need an
    order by blocks of their own, so they come first, while the rows that are sorted for them are narrow.
    """
    d = macd(df, keys, emas={f"ema_{n}": n for n in (5, 10, 20)})
    smooth = [n for n in d.columns if n not in df.columns]
    d = add_features(
        d,
        [
            moving_average_features(), rsi_features(), bollinger_features(), stochastic_features(), atr_features(),
            williams_features(), return_features(), realized_vol_features(), garch_features(), parkinson_features(),
            garman_klass_features(), price_impact_features(), vwap_features(), mfi_features(),
            volume_ratio_features(), calendar_features(), lag_features(),
        ],
        keys,
    )
    d = d.select(*[n for n in d.columns if n not in smooth], *smooth)
    return d.na.drop() if drop_incomplete else d


def all_features_any_length(
    df: DataFrame, cadence_seconds: int, keys: Sequence[str] = KEYS, chunk_rows: int = 200_000, drop_incomplete: bool = True
) -> DataFrame:
    """``all_features`` for bars of any cadence and series of any length.

    Every series is cut into chunks of ``chunk_rows`` that bring the rows along which their features
    look back at; results are those of ``all_features``.
    """
    d = over_chunks(
        df, lambda x, k: all_features(x, k, False), keys, ["ts"], time_bucket(cadence_seconds * 50_000), FEATURE_LOOKBACK, chunk_rows
    )
    return d.na.drop() if drop_incomplete else d
