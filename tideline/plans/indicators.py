"""Queries of the indicator family over daily bars."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import functions as F

from tideline.functions.rolling import add_ema, ema_lookback, rolling, series_window, sma
from tideline.operators import indicators as ind
from tideline.operators.ordered import Slices, over_chunks, running
from tideline.plans.inputs import BARS_D, EVENT_TICKS, TICKS, bars_d, epoch, event_ticks
from tideline.plans.registry import query

W = "PARTITION BY series_key ORDER BY ts"


def roll(agg: str, x: str, n: int) -> str:
    f = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {n} THEN {agg}({x}) {f} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def _sql(outputs: dict[str, str], steps: list[dict[str, str]] = ()) -> str:
    """SELECT key, ts and the outputs over bars, after helper columns added step by step."""
    ctes, source = [BARS_D], "bars"
    for i, step in enumerate(steps):
        ctes.append(f"step{i} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM {source})")
        source = f"step{i}"
    cols = ", ".join(f"{x} AS {n}" for n, x in outputs.items())
    return f"WITH {', '.join(ctes)} SELECT series_key, epoch(ts)::BIGINT AS ts, {cols} FROM {source}"


def feature(name: str, made: Callable[[], ind.Feature], outputs: dict[str, str], steps=(), ints: str = "", digits: int = 6):
    floats = " ".join(c for c in outputs if c not in ints.split())

    @query(name, _sql(outputs, steps), floats, digits)
    def run(spark, d):
        return epoch(ind.add_features(bars_d(spark, d), [made()])).select("series_key", "ts", *outputs)




feature("sma", ind.moving_average_features, {f"sma_{n}": roll("avg", "close", n) for n in (5, 10, 20, 50)})


# The exponential means are stated as a join of each row with its history.
def _ema_join(spans: dict[str, int], value: str, source: str) -> str:
    terms = ", ".join(
        f"sum(b.{value} * pow({1 - 2 / (s + 1)!r}, a.rn - b.rn)) / sum(pow({1 - 2 / (s + 1)!r}, a.rn - b.rn)) AS {n}"
        for n, s in spans.items()
    )
    return (f"SELECT a.series_key, a.ts, a.rn, {terms} FROM {source} a JOIN {source} b "
            "ON a.series_key = b.series_key AND b.rn <= a.rn GROUP BY 1, 2, 3")


_NUMBERED = BARS_D + f", n AS (SELECT series_key, ts, close, row_number() OVER ({W}) AS rn FROM bars)"


@query("ema", f"WITH {_NUMBERED}, e AS ({_ema_join({'ema_5': 5, 'ema_10': 10, 'ema_20': 20}, 'close', 'n')}) "
       "SELECT series_key, epoch(ts)::BIGINT AS ts, ema_5, ema_10, ema_20 FROM e", "ema_5 ema_10 ema_20", digits=4)
def ema(spark, d):
    return epoch(ind.exponential_averages(bars_d(spark, d))).select("series_key", "ts", "ema_5", "ema_10", "ema_20")


@query("macd", f"WITH {_NUMBERED}, e AS ({_ema_join({'f': 12, 's': 26}, 'close', 'n')}), "
       f"m AS (SELECT *, f - s AS macd FROM e), g AS ({_ema_join({'macd_signal': 9}, 'macd', 'm')}) "
       "SELECT series_key, epoch(m.ts)::BIGINT AS ts, macd, macd_signal, macd - macd_signal AS macd_histogram "
       "FROM m JOIN g USING (series_key, rn)", "macd macd_signal macd_histogram", digits=4)
def macd(spark, d):
    return epoch(ind.macd(bars_d(spark, d))).select("series_key", "ts", "macd", "macd_signal", "macd_histogram")


def _rsi_out(n):
    return (f"CASE WHEN l{n} <> 0 THEN 100 - 100.0 / (1 + u{n} / l{n}) WHEN u{n} > 0 THEN 100.0 END")


feature("rsi", ind.rsi_features, {f"rsi_{n}": _rsi_out(n) for n in (14, 30)}, [
    {"d": f"coalesce(close - {lag('close')}, 0.0)"},
    {"u": "greatest(d, 0.0)", "l": "greatest(-d, 0.0)"},
    {f"{s}{n}": roll("avg", s, n) for s in "ul" for n in (14, 30)},
])
_BB = [{"mid": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20)},
       {"up": "mid + 2 * sd", "lo": "mid - 2 * sd"}]
_BBO = {"bb_upper": "up", "bb_middle": "mid", "bb_lower": "lo", "bb_position": "(close - lo) / (up - lo)"}
feature("bollinger", ind.bollinger_features, {**_BBO, "bb_width": "(up - lo) / mid"}, _BB)
feature("bollinger_abs_width", lambda: ind.bollinger_features(relative_width=False), {**_BBO, "bb_width": "up - lo"}, _BB)
_HL = {"hh": roll("max", "high", 14), "ll": roll("min", "low", 14)}
feature("stochastic", ind.stochastic_features, {"stoch_k": "k", "stoch_d": roll("avg", "k", 3)},
        [_HL, {"k": "CASE WHEN hh <> ll THEN 100 * (close - ll) / (hh - ll) END"}])
feature("atr", ind.atr_features, {"atr": roll("avg", "tr", 14)}, [
    {"pc": lag("close")}, {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))"}])
feature("williams_r", ind.williams_features, {"williams_r": "CASE WHEN hh <> ll THEN -100 * (hh - close) / (hh - ll) END"}, [_HL])
_RET = {"r": f"close / {lag('close')} - 1"}
feature("returns", ind.return_features, {"returns": "r", "log_returns": f"ln(close / {lag('close')})"}, [_RET])
feature("realized_vol", ind.realized_vol_features,
        {f"realized_vol_{n}": f"({roll('stddev_samp', 'r', n)}) * sqrt(252)" for n in (10, 30)}, [_RET])
feature("garch_approx", ind.garch_features, {"garch_vol": f"sqrt(({roll('var_samp', 'r', 100)}) * 252)"}, [_RET])
feature("parkinson_vol", ind.parkinson_features, {"parkinson_vol": f"sqrt(({roll('avg', 'x', 30)}) * 252)"},
        [{"x": "pow(ln(high / low), 2) / (4 * ln(2))"}])
feature("garman_klass_vol", ind.garman_klass_features,
        {"garman_klass_vol": "CASE WHEN g >= 0 THEN sqrt(g) END"},
        [{"x": "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"},
         {"g": f"({roll('avg', 'x', 30)}) * 252"}])
feature("price_impact", ind.price_impact_features, {"price_impact": f"abs(r) / (({roll('avg', 'volume', 20)}) + 1e-8)"}, [_RET])
_TP = {"tp": "(high + low + close) / 3"}
feature("vwap", ind.vwap_features, {"vwap": f"({roll('sum', 'pv', 20)}) / ({roll('sum', 'volume', 20)})"},
        [_TP, {"pv": "tp * volume"}])
feature("mfi", ind.mfi_features, {"mfi": "CASE WHEN l <> 0 THEN 100 - 100.0 / (1 + g / l) WHEN g > 0 THEN 100.0 END"}, [
    _TP, {"s": f"coalesce(tp - {lag('tp')}, 0.0)", "m": "tp * volume"},
    {"gain": "CASE WHEN s > 0 THEN m ELSE 0.0 END", "loss": "CASE WHEN s < 0 THEN m ELSE 0.0 END"},
    {"g": roll("sum", "gain", 14), "l": roll("sum", "loss", 14)}])
feature("volume_ratio", ind.volume_ratio_features, {"volume_sma": "vs", "volume_ratio": "volume / vs"}, [{"vs": roll("avg", "volume", 10)}])
feature("lags", ind.lag_features, {f"{c}_lag_{n}": lag(c, n) for c in ("close", "volume", "high", "low") for n in (1, 2, 3, 5, 10)})
feature("lag_series", lambda: ind.lag_features(("close", "volume"), range(1, 11), "lag_{c}_{n}"), {f"lag_{c}_{n}": lag(c, n) for c in ("close", "volume") for n in range(1, 11)})
feature("candle_shape", ind.candle_features, {
    "high_low_ratio": "high / low", "open_close_ratio": "open / close", "price_range": "high - low",
    "body_size": "abs(close - open)", "upper_shadow": "high - greatest(open, close)",
    "lower_shadow": "least(open, close) - low"})
feature("rolling_dispersion", ind.dispersion_features, {f"{c}_std_10": roll("stddev_samp", c, 10) for c in ("close", "volume")})
feature("momentum", ind.momentum_features, {f"momentum_{n}": f"close / {lag('close', n)}" for n in (5, 10, 14)})
feature("roc", ind.momentum_features, {f"roc_{n}": f"(close / {lag('close', n)} - 1) * 100" for n in (5, 10, 14)})
feature("volume_price_trend", ind.volume_price_trend_features, {"volume_price_trend": f"volume * (close / {lag('close')} - 1)"})
@query("obv", _sql({"obv": f"sum(sv) OVER ({W} ROWS UNBOUNDED PRECEDING)"}, [{"sv": f"coalesce(sign(close - {lag('close')}), 0) * volume"}]), "obv")
def obv(spark, d):
    return epoch(ind.obv(bars_d(spark, d))).select("series_key", "ts", "obv")


feature("candle_patterns", ind.pattern_features, {
    "doji": "CASE WHEN abs(close - open) <= 0.1 * (high - low) THEN 1 ELSE 0 END",
    "hammer": "CASE WHEN least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open) THEN 1 ELSE 0 END",
}, ints="doji hammer")
feature("trend_flags", ind.trend_flag_features, {
    "above_sma_20": "CASE WHEN close > a THEN 1 ELSE 0 END", "above_sma_50": "CASE WHEN close > b THEN 1 ELSE 0 END",
    "sma_20_above_50": "CASE WHEN a > b THEN 1 ELSE 0 END",
}, [{"a": roll("avg", "close", 20), "b": roll("avg", "close", 50)}], "above_sma_20 above_sma_50 sma_20_above_50")
feature("ratio_features", ind.ratio_to_mean_features, {
    "volume_to_sma": f"volume / ({roll('avg', 'volume', 20)})", "price_to_sma": f"close / ({roll('avg', 'close', 20)})"})
_CAL = {"hour": "hour(ts)::INT", "day_of_week": "(isodow(ts) - 1)::INT", "month": "month(ts)::INT", "quarter": "quarter(ts)::INT"}
feature("temporal_enhance", ind.enhance_features, {
    "price_lag_1": lag("close"), "price_change": f"close / {lag('close')} - 1",
    "price_volatility": roll("stddev_samp", "close", 24), **_CAL}, ints="hour day_of_week month quarter")
feature("cyclic_time", ind.calendar_features, {
    **_CAL, "day_of_month": "day(ts)::INT",
    "hour_sin": "sin(2 * pi() * hour(ts) / 24)", "hour_cos": "cos(2 * pi() * hour(ts) / 24)",
    "dow_sin": "sin(2 * pi() * (isodow(ts) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(ts) - 1) / 7)"},
    ints="hour day_of_week month quarter day_of_month")
feature("normalised_slope", ind.slope_features, {"normalised_slope": "CASE WHEN n = 10 THEN greatest(-1.0, least(1.0, -((close - f) / 9 / a))) END"}, [
    {"n": f"count(close) OVER ({W} ROWS 9 PRECEDING)", "f": f"first_value(close) OVER ({W} ROWS 9 PRECEDING)",
     "a": f"avg(close) OVER ({W} ROWS 9 PRECEDING)"}])


_ALL_STEPS = [
    {"rn": f"row_number() OVER ({W})", "r": f"close / {lag('close')} - 1", "d": f"coalesce(close - {lag('close')}, 0.0)",
     "s20": roll("avg", "close", 20), "s50": roll("avg", "close", 50), "hh": roll("max", "high", 14), "ll": roll("min", "low", 14),
     "gk": "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)",
     "tp": "(high + low + close) / 3"},
    {"k": "CASE WHEN hh <> ll THEN 100 * (close - ll) / (hh - ll) END", "u": "greatest(d, 0.0)", "l": "greatest(-d, 0.0)",
     "st": f"coalesce(tp - {lag('tp')}, 0.0)", "m": "tp * volume", "g100": f"sqrt(({roll('var_samp', 'r', 100)}) * 252)",
     "gkv": f"({roll('avg', 'gk', 30)}) * 252"},
    {"kd": roll("avg", "k", 3), "u14": roll("avg", "u", 14), "l14": roll("avg", "l", 14), "u30": roll("avg", "u", 30),
     "l30": roll("avg", "l", 30), "gain": "CASE WHEN st > 0 THEN m ELSE 0.0 END", "loss": "CASE WHEN st < 0 THEN m ELSE 0.0 END"},
    {"g14": roll("sum", "gain", 14), "lo14": roll("sum", "loss", 14)},
    {"rsi_14": _rsi_out(14), "rsi_30": _rsi_out(30),
     "mfi": "CASE WHEN lo14 <> 0 THEN 100 - 100.0 / (1 + g14 / lo14) WHEN g14 > 0 THEN 100.0 END"},
]


def _dropna_sql(select: str) -> str:
    ctes, source = [BARS_D], "bars"
    for i, step in enumerate(_ALL_STEPS):
        ctes.append(f"step{i} AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in step.items())} FROM {source})")
        source = f"step{i}"
    return (f"WITH {', '.join(ctes)} SELECT {select} FROM {source} WHERE rn > 100 AND gkv >= 0 AND s50 IS NOT NULL "
            "AND kd IS NOT NULL AND rsi_14 IS NOT NULL AND rsi_30 IS NOT NULL AND mfi IS NOT NULL AND g100 IS NOT NULL")


@query("all_features", _dropna_sql(
    "series_key, epoch(ts)::BIGINT AS ts, close, s20 AS sma_20, s50 AS sma_50, k AS stoch_k, kd AS stoch_d, rsi_14, rsi_30, mfi, "
    "g100 AS garch_vol, sqrt(gkv) AS garman_klass_vol"),
    "close sma_20 sma_50 stoch_k stoch_d rsi_14 rsi_30 mfi garch_vol garman_klass_vol")
def all_features(spark, d):
    """Rows of the complete feature table (62 features, all must be present) and a cut of its columns."""
    return epoch(ind.all_features(bars_d(spark, d))).select(
        "series_key", "ts", "close", "sma_20", "sma_50", "stoch_k", "stoch_d", "rsi_14", "rsi_30", "mfi",
        "garch_vol", "garman_klass_vol")


@query("all_features_chunked", f"WITH {BARS_D} SELECT series_key, epoch(ts)::BIGINT AS ts, {roll('avg', 'close', 20)} AS sma_20, "
       f"{roll('stddev_samp', 'r', 10)} AS vol_10, {lag('volume', 3)} AS volume_lag_3 FROM (SELECT *, close / {lag('close')} - 1 AS r FROM bars)", "sma_20 vol_10 volume_lag_3")
def all_features_chunked(spark, d):
    """The feature table of long series: every series in chunks of 600 rows with their history."""
    f = ind.all_features_any_length(bars_d(spark, d), 86400, chunk_rows=600, drop_incomplete=False)
    return epoch(f).select("series_key", "ts", "sma_20", (F.col("realized_vol_10") / math.sqrt(252)).alias("vol_10"), "volume_lag_3")


@query("dropna_features", f"SELECT series_key, count(*) AS n_rows, min(ts) AS first_ts FROM ({_dropna_sql('series_key, epoch(ts)::BIGINT AS ts')}) GROUP BY 1")
def dropna_features(spark, d):
    f = epoch(ind.all_features(bars_d(spark, d)))
    return f.groupBy("series_key").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"))


# --- the same on raw ticks: five series that hold all rows of the table ------------------

HOUR = 3600
_T = f"PARTITION BY series_key ORDER BY seq"


def _tick(x: str, n: int, agg: str = "avg") -> str:
    f = f"OVER ({_T} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} = {n} THEN {agg}({x}) {f} END"


@query("tick_features", f"WITH {EVENT_TICKS} SELECT series_key, seq, {_tick('price', 20)} AS sma_20, "
       f"{_tick('price', 10, 'stddev_samp')} AS std_10, lag(price, 5) OVER ({_T}) AS lag_5 FROM event_ticks",
       "sma_20 std_10 lag_5")
def tick_features(spark, d):
    """Fixed-lookback features of hot series: equal row chunks with carried-over history."""

    def fn(df, keys):
        w = series_window(keys, ["seq"])
        return df.withColumns(
            {
                "sma_20": sma(F.col("price"), 20, w),
                "std_10": rolling(F.stddev_samp, F.col("price"), 10, w),
                "lag_5": F.lag("price", 5).over(w),
            }
        )

    out = over_chunks(event_ticks(spark, d), fn, ["series_key"], ["seq"], Slices(HOUR, TICKS), lookback=20)
    return out.select("series_key", "seq", "sma_20", "std_10", "lag_5")


@query("tick_running", f"WITH {EVENT_TICKS} SELECT series_key, seq, sum(price) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS total, "
       f"max(price) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS top, min(price) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS bottom, "
       f"last_value(CASE WHEN seq % 3 = 0 THEN price END IGNORE NULLS) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS filled FROM event_ticks",
       "total top bottom filled")
def tick_running(spark, d):
    """Cumulative values of hot series: two-level scan over hourly slices."""
    p = F.col("price")
    out = running(
        event_ticks(spark, d), ["series_key"], ["seq"],
        {"total": ("sum", p), "top": ("max", p), "bottom": ("min", p),
         "filled": ("last", F.when(F.col("seq") % 3 == 0, p))},
        Slices(HOUR, TICKS),
    )
    return out.select("series_key", "seq", "total", "top", "bottom", "filled")


@query("tick_ema", f"WITH {EVENT_TICKS}, n AS (SELECT series_key, seq AS ts, price, row_number() OVER ({_T}) AS rn FROM event_ticks), "
       f"e AS ({_ema_join({'ema_20': 20}, 'price', 'n')}) SELECT series_key, ts AS seq, ema_20 FROM e", "ema_20", digits=4)
def tick_ema(spark, d):
    """Exponential mean of hot series: chunks carry enough history for double precision."""

    def fn(df, keys):
        return add_ema(df, {"ema_20": (F.col("price"), 20)}, keys, ["seq"])

    out = over_chunks(event_ticks(spark, d), fn, ["series_key"], ["seq"], Slices(HOUR, TICKS), ema_lookback([20]))
    return out.select("series_key", "seq", "ema_20")
