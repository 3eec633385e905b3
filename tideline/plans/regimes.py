"""Queries: regimes, labels, prompts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tideline.functions.rolling import series_window
from tideline.operators import regimes as rg
from tideline.operators.ordered import over_chunks, time_bucket
from tideline.plans.inputs import BARS_D, EVENT_TICKS, ORDER_DAYS, POSTS, bars_d, epoch, event_ticks, order_days, posts
from tideline.plans.registry import query
from tideline.plans.splits import PANEL, panel

W = "PARTITION BY series_key ORDER BY ts"
TS = "epoch(ts)::BIGINT AS ts"


def prices(spark, d):
    """Daily closes on a scale whose returns fall into all volatility classes."""
    k = 4 + (F.col("series_key") % 5) * 12
    return bars_d(spark, d).select("series_key", "ts", (F.col("close") / k + 10000).alias("close"))


PRICES = BARS_D + ", pr AS (SELECT series_key, ts, close / (4 + (series_key % 5) * 12) + 10000 AS close FROM bars)"


def three(x: str, up: str) -> str:
    return f"CASE WHEN {x} > {up} THEN 'bull' WHEN {x} < -{up} THEN 'bear' ELSE 'sideways' END"


_RG = PRICES + f""", r0 AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, row_number() OVER ({W}) AS i FROM pr),
r1 AS (SELECT *, count(r) OVER f AS k, avg(r) OVER f AS m, stddev_pop(r) OVER f AS v FROM r0 WINDOW f AS ({W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
r2 AS (SELECT *, CASE WHEN k < 30 THEN NULL WHEN v < 0.02 THEN {three('m', '0.001')} || '_low_vol' WHEN v > 0.05 THEN {three('m', '0')} || '_high_vol' ELSE {three('m', '0.0005')} || '_med_vol' END AS label FROM r1),
rg AS (SELECT series_key, ts, close, i, coalesce(label, max(CASE WHEN i = 32 THEN label END) OVER (PARTITION BY series_key)) AS regime FROM r2)"""


@query("regime_rolling", f"WITH {_RG} SELECT series_key, {TS}, regime FROM rg")
def regime_rolling(spark, d):
    return epoch(rg.regime_rolling(prices(spark, d))).select("series_key", "ts", "regime")


@query("regime_stats", f"""WITH {_RG}, x AS (SELECT *, lead(close) OVER ({W}) / close - 1 AS nx, max(ts) OVER (PARTITION BY series_key, regime) AS lt FROM rg),
g AS (SELECT series_key, regime, count(*) AS n, avg(nx) FILTER (ts < lt) AS avg_return, stddev_pop(nx) FILTER (ts < lt) AS volatility FROM x GROUP BY 1, 2)
SELECT *, avg_return / (volatility + 1e-8) AS sharpe_ratio FROM g WHERE n > 1""", "avg_return volatility sharpe_ratio", digits=4)
def regime_stats(spark, d):
    return rg.regime_stats(rg.regime_rolling(prices(spark, d)))


_LL = PRICES + f""", q0 AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS r, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY series_key) AS n FROM pr),
q1 AS (SELECT series_key, max(n) AS n, avg(r) FILTER (k <= 30) AS m, stddev_pop(r) FILTER (k <= 30) AS v, max(close) FILTER (k = 1) / max(close) FILTER (k = 10) - 1 AS mv FROM q0 GROUP BY 1)"""


@query("regime_latest", f"""WITH {_LL} SELECT series_key, CASE WHEN n < 30 THEN 'unknown' ELSE {three('m', '0.001')} || CASE WHEN v < 0.015 THEN '_low_vol' WHEN v > 0.04 THEN '_high_vol' ELSE '_med_vol' END END AS regime FROM q1""")
def regime_latest(spark, d):
    return rg.latest_labels(prices(spark, d)).drop("trend_direction")


@query("trend_direction", f"WITH {_LL} SELECT series_key, CASE WHEN n < 10 THEN 'neutral' WHEN mv > 0.02 THEN 'upward' WHEN mv < -0.02 THEN 'downward' ELSE 'neutral' END AS trend_direction FROM q1")
def trend_direction(spark, d):
    return rg.latest_labels(prices(spark, d)).drop("regime")


@query("volatility_level", f"""WITH {_LL}, v AS (SELECT series_key, count(*) AS n, stddev_pop(r) AS v FROM q0 GROUP BY 1)
SELECT series_key, CASE WHEN n < 10 THEN 'medium' WHEN v < 0.015 THEN 'low' WHEN v > 0.04 THEN 'high' ELSE 'medium' END AS volatility_level FROM v""")
def volatility_level(spark, d):
    return rg.volatility_level(prices(spark, d))


_SES = "CASE WHEN hour(ts) < 8 THEN 'asian_session' WHEN hour(ts) < 16 THEN 'european_session' ELSE 'us_session' END"
_DAY = "CASE WHEN isodow(ts) >= 6 THEN 'weekend' WHEN isodow(ts) = 1 THEN 'monday' WHEN isodow(ts) = 5 THEN 'friday' ELSE 'weekday' END"


@query("session_label", f"WITH {EVENT_TICKS} SELECT seq, {_SES} AS session, {_DAY} AS day_class FROM event_ticks")
def session_label(spark, d):
    return event_ticks(spark, d).select("seq", rg.session_label(F.hour("ts")).alias("session"), rg.day_label(F.weekday("ts")).alias("day_class"))


_MAC = "CASE WHEN risk > 2 AND rate < 3 THEN 'bullish' WHEN risk < -2 OR rate > 6 THEN 'bearish' ELSE 'neutral' END"
_ONC = "CASE WHEN momentum > 0 AND flow < 0 THEN 'strong' WHEN momentum < 0 AND flow > 0 THEN 'weak' ELSE 'moderate' END"
_SEN = "CASE WHEN s < 0.2 THEN 'extremely bearish' WHEN s < 0.4 THEN 'bearish' WHEN s < 0.6 THEN 'neutral' WHEN s < 0.8 THEN 'bullish' ELSE 'extremely bullish' END"
_FG = "CASE WHEN f < 25 THEN 'extreme fear' WHEN f < 45 THEN 'fear' WHEN f < 55 THEN 'neutral' WHEN f < 75 THEN 'greed' ELSE 'extreme greed' END"
_ENV = ORDER_DAYS + """, env AS (SELECT ts, avg_price / 40000 AS rate, (n_orders - 6) * 1.0::DOUBLE AS risk, n_orders - lag(n_orders) OVER (ORDER BY ts) AS momentum,
  filled - lag(filled) OVER (ORDER BY ts) AS flow FROM order_days)"""


def environment(spark, d):
    """Daily macro and network figures of one unnamed series, in chunks of days."""

    def fn(df, keys):
        w = series_window(keys)
        return df.withColumns(
            {"momentum": (F.col("n_orders") - F.lag("n_orders").over(w)).cast("double"), "flow": F.col("filled") - F.lag("filled").over(w)}
        )

    o = over_chunks(order_days(spark, d), fn, [], ["ts"], time_bucket(365 * 86400), lookback=1, chunk_rows=4096)
    return o.select("ts", (F.col("avg_price") / 40000).alias("rate"), ((F.col("n_orders") - 6) * 1.0).alias("risk"), "momentum", "flow")


@query("macro_label", f"WITH {_ENV} SELECT {TS}, {_MAC} AS macro_environment, {_ONC} AS onchain_strength FROM env")
def macro_label(spark, d):
    e = environment(spark, d)
    return epoch(e).select("ts", rg.macro_label(F.col("rate"), F.col("risk")).alias("macro_environment"), rg.onchain_label(F.col("momentum"), F.col("flow")).alias("onchain_strength"))


@query("sentiment_label", f"WITH {POSTS}, x AS (SELECT post_id, (polarity + 1) / 2 AS s, polarity * 50 + 50 AS f FROM posts) SELECT post_id, {_SEN} AS sentiment, {_FG} AS fear_greed FROM x")
def sentiment_label(spark, d):
    p = posts(spark, d)
    return p.select("post_id", rg.sentiment_label((F.col("polarity") + 1) / 2).alias("sentiment"), rg.fear_greed_label(F.col("polarity") * 50 + 50).alias("fear_greed"))


def context_rows(spark, d):
    p = prices(spark, d).join(environment(spark, d), "ts", "left")
    return rg.market_context(p.withColumns({"sentiment_score": F.col("rate") / 10, "fear_greed_index": F.col("rate") * 10}))


@query("market_context", f"""WITH {PRICES}, {_ENV}, x AS (SELECT pr.*, close / lag(close) OVER ({W}) - 1 AS mom, rate, risk, momentum, flow FROM pr LEFT JOIN env USING (ts)),
y AS (SELECT series_key, ts, mom, rate / 10 AS ss, rate * 10 AS fg, coalesce(rate, 5.0) AS rate, coalesce(risk, 0.0) AS risk, coalesce(momentum, 0) AS momentum, coalesce(flow, 0) AS flow FROM x)
SELECT series_key, {TS}, mom AS price_momentum, coalesce(ss, 0.5) AS sentiment_score, coalesce(trunc(fg)::INT, 50) AS fear_greed_index, {_MAC} AS macro_environment,
  {_ONC} AS onchain_strength, {_SES} AS time_of_day, {_DAY} AS day_of_week FROM y""", "price_momentum sentiment_score")
def market_context(spark, d):
    return epoch(context_rows(spark, d)).select("series_key", "ts", "context.*")


def _said(kind: str, label: str) -> str:
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rg.PHRASES[kind].items()) + f" ELSE coalesce(replace({label}, '_', ' '), 'unknown') END"


def _template(template: str, values: dict[str, str]) -> str:
    """SQL text of a filled template."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"'{x}'" if i % 2 == 0 else f"({values[x]})" for i, x in enumerate(parts))


_CONTEXT = {"horizon": "'24'", "reach": f"'{rg.reach(24)}'", "style": _said("style", "'swing_trading'"), "source": _said("source", "'multi_source'"),
            "sentiment": _SEN, "fear_greed": _FG, "time_of_day": _said("time_of_day", _SES), "day_of_week": _said("day_of_week", _DAY)}
_CONTEXT |= {k: _said(k, v) for k, v in (("regime", "regime"), ("volatility_level", "volatility_level"), ("macro_environment", _MAC), ("onchain_strength", _ONC))}


@query("context_prompt", f"""WITH {_RG}, {_ENV.removeprefix('WITH ')}, vr AS (SELECT series_key, close / lag(close) OVER ({W}) - 1 AS vx FROM pr),
vl AS (SELECT series_key, CASE WHEN count(*) < 10 THEN 'medium' WHEN stddev_pop(vx) < 0.015 THEN 'low' WHEN stddev_pop(vx) > 0.04 THEN 'high' ELSE 'medium' END AS volatility_level FROM vr GROUP BY 1),
x AS (SELECT series_key, ts, regime, volatility_level, coalesce(rate / 10, 0.5) AS s, coalesce(trunc(rate * 10)::INT, 50) AS f, coalesce(rate, 5.0) AS rate, coalesce(risk, 0.0) AS risk,
  coalesce(momentum, 0) AS momentum, coalesce(flow, 0) AS flow FROM rg LEFT JOIN env USING (ts) JOIN vl USING (series_key))
SELECT series_key, {TS}, regime, {_template(rg.CONTEXT_TEMPLATE, _CONTEXT)} AS prompt FROM x""")
def context_prompt(spark, d):
    c = rg.regime_rolling(context_rows(spark, d)).join(rg.volatility_level(prices(spark, d)), "series_key")
    return epoch(rg.context_prompt(c, 24)).select("series_key", "ts", "regime", "prompt")


@query("autocorr_top_lags", f"""WITH {PANEL}, l AS (SELECT series_id, len(vals) AS n, unnest(vals) AS x, generate_subscripts(vals, 1) - 1 AS t FROM panel),
c AS (SELECT a.series_id, k.lag, round(sum(a.x * b.x), 6) AS value FROM l a JOIN (SELECT unnest(range(128)) AS lag) k ON k.lag < a.n
  JOIN l b ON a.series_id = b.series_id AND b.t = (a.t + k.lag) % a.n GROUP BY 1, 2)
SELECT series_id, place::INT AS place, lag::INT AS lag, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, lag) AS place FROM c) WHERE place <= 5""", "value")
def autocorr_top_lags(spark, d):
    t = rg.autocorr_top_lags(panel(spark, d), "vals")
    return t.select("series_id", F.posexplode("top_lags").alias("p", "x")).select("series_id", (F.col("p") + 1).alias("place"), "x.lag", "x.value")


_WINDOW = {"about": "'Daily closes of one supplier.'", "horizon": "'24'", "steps": "n::VARCHAR", "low": "(floor(low * 100) / 100)::DECIMAL(18,2)::VARCHAR", "high": "(floor(high * 100) / 100)::DECIMAL(18,2)::VARCHAR",
           "median": "(floor(median * 100) / 100)::DECIMAL(18,2)::VARCHAR", "trend": "CASE WHEN rise > 0 THEN 'above' ELSE 'below' END", "lags": "lags"}


@query("window_prompt", f"""WITH {PRICES}, q AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM pr),
l AS (SELECT series_key, ts, close AS x, row_number() OVER ({W}) - 1 AS t, count(*) OVER (PARTITION BY series_key) AS n FROM q WHERE k <= 96),
c AS (SELECT a.series_key, g.lag, round(sum(a.x * b.x), 2) AS value FROM l a JOIN (SELECT unnest(range(96)) AS lag) g ON g.lag < a.n
  JOIN l b ON a.series_key = b.series_key AND b.t = (a.t + g.lag) % a.n GROUP BY 1, 2),
top AS (SELECT series_key, string_agg(lag::VARCHAR, ', ' ORDER BY place) AS lags FROM (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY value DESC, lag) AS place FROM c) WHERE place <= 5 GROUP BY 1),
st AS (SELECT series_key, count(*) AS n, min(x) AS low, max(x) AS high, quantile_disc(x, 0.5) AS median, arg_max(x, ts) - arg_min(x, ts) AS rise FROM l GROUP BY 1)
SELECT series_key, CASE WHEN rise > 0 THEN 'upward' ELSE 'downward' END AS trend, median, {_template(rg.WINDOW_TEMPLATE, _WINDOW)} AS prompt FROM st JOIN top USING (series_key)""", "median")
def window_prompt(spark, d):
    """Text rows over the last 96 closes of every series."""
    w = rg.window_arrays(prices(spark, d), "close", 96)
    return rg.window_prompt(w, "values", "Daily closes of one supplier.", 24).select("series_key", "trend", "median", "prompt")


@query("window_statistics", f"""WITH {PRICES}, q AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM pr)
SELECT series_key, min(close) AS low, max(close) AS high, quantile_disc(close, 0.5) AS median,
  CASE WHEN arg_max(close, ts) - arg_min(close, ts) > 0 THEN 'upward' ELSE 'downward' END AS trend FROM q WHERE k <= 96 GROUP BY 1""", "low high median")
def window_statistics(spark, d):
    """The figures a window prompt states."""
    w = rg.window_arrays(prices(spark, d), "close", 96)
    p = rg.window_prompt(w, "values", "", 24)
    return p.select("series_key", F.array_min("values").alias("low"), F.array_max("values").alias("high"), "median", "trend")


@query("prompt_performance", """WITH p AS (SELECT o_orderpriority || '/' || (o_custkey % 20) AS prompt_key, o_totalprice / 100000 AS mse FROM orders)
SELECT prompt_key, avg(mse) AS mean_metric FROM p GROUP BY 1 ORDER BY round(avg(mse), 9), prompt_key LIMIT 5""", "mean_metric")
def prompt_performance(spark, d):
    from tideline.plans.inputs import table

    o = table(spark, d, "orders")
    p = o.select(F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 20).cast("string")).alias("prompt_key"), (F.col("o_totalprice") / 100000).alias("mse"))
    return rg.prompt_performance(p, "prompt_key", "mse")
