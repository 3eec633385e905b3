"""Queries: signals, back-tests, sweeps, leaderboards, forecasts, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import backtest as bt
from tideline.operators import forecasting as fc
from tideline.operators import indicators as ind
from tideline.operators import splits as sp
from tideline.operators.ordered import Slices
from tideline.plans.inputs import CALM, EVENT_TICKS, FORECASTS, TICKS, calm_bars, epoch, event_ticks, forecasts
from tideline.plans.registry import query
from tideline.plans.splits import _WLK as WALK_SQL

FW = "PARTITION BY model, series_key ORDER BY ts"
W = "PARTITION BY series_key ORDER BY ts"
TS = "epoch(ts)::BIGINT AS ts"
MODELS = ["naive", "mean10", "trend5"]


def fcast(spark, d):
    return forecasts(spark, d).withColumnRenamed("actual", "close")


FC = FORECASTS + ", fc AS (SELECT * RENAME (actual AS close) FROM forecasts)"


def beyond(x: str, c: str) -> str:
    return f"CASE WHEN {x} > {c} THEN 1 WHEN {x} < -{c} THEN -1 ELSE 0 END"


_DIR = f"CASE WHEN abs(predicted / lag(predicted) OVER ({FW}) - 1) > {{c}} THEN sign(predicted - lag(predicted) OVER ({FW}))::INT ELSE 0 END"
_HYB = f"""CASE WHEN 0.7 * CASE WHEN predicted > close THEN 1.0 ELSE -1.0 END + 0.3 * CASE WHEN count(*) OVER ({FW} ROWS 19 PRECEDING) = 20
  AND avg(close) OVER ({FW} ROWS 4 PRECEDING) > avg(close) OVER ({FW} ROWS 19 PRECEDING) THEN 1.0 ELSE -1.0 END > 0.3 THEN 1 ELSE -1 END"""
_BH = f"CASE WHEN row_number() OVER ({FW}) = 1 THEN 1 WHEN lead(ts) OVER ({FW}) IS NULL THEN -1 ELSE 0 END"
_SIGNALS = {
    "signal_threshold": (lambda f: bt.signal_threshold(f, 0.001), beyond("(predicted - close) / close", "0.001")),
    "signal_threshold_horizon": (
        lambda f: bt.signal_threshold(f, 0.001, horizon=3),
        f"CASE WHEN row_number() OVER ({FW}) > 3 AND lead(predicted) OVER ({FW}) IS NOT NULL THEN "
        + beyond(f"(lead(predicted) OVER ({FW}) / lag(predicted, 2) OVER ({FW}) - 1)", "0.001") + " ELSE 0 END",
    ),
    "signal_threshold_lag": (lambda f: bt.signal_threshold_lag(f, 0.001), f"coalesce({beyond(f'(lag(predicted) OVER ({FW}) - close) / close', '0.001')}, 0)"),
    "signal_directional": (lambda f: bt.signal_directional(f, 0.001), _DIR.format(c="0.001")),
    "signal_hybrid": (bt.signal_hybrid, _HYB),
    "signal_buy_hold": (bt.signal_buy_hold, _BH),
}
for _name, (_fn, _s) in _SIGNALS.items():

    @query(_name, f"WITH {FC} SELECT model, series_key, {TS}, {_s} AS signal FROM fc")
    def signal(spark, d, fn=_fn):
        return epoch(fn(fcast(spark, d))).select("model", "series_key", "ts", "signal")


def _test(by: str, source: str, fee: str = "0.001") -> str:
    w = f"PARTITION BY {by} ORDER BY ts"
    return f"""b1 AS (SELECT *, coalesce(last_value(CASE WHEN signal <> 0 THEN signal END IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING), -1) AS state FROM {source}),
b2 AS (SELECT *, coalesce(lag(state) OVER ({w}), -1) AS held, lag(close) OVER ({w}) AS pc FROM b1),
b3 AS (SELECT *, CASE WHEN held = 1 THEN close / pc ELSE 1.0 END * CASE WHEN state <> held THEN 1 - {fee} ELSE 1.0 END AS factor,
  CASE WHEN state <> held THEN CASE WHEN state = 1 THEN 'buy' ELSE 'sell' END END AS side,
  last_value(CASE WHEN state <> held THEN close END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM b2),
b4 AS (SELECT *, 1000 * product(factor) OVER ({w} ROWS UNBOUNDED PRECEDING) AS equity, CASE WHEN pc IS NULL THEN 0.0 ELSE factor - 1 END AS ret FROM b3),
b5 AS (SELECT *, max(equity) OVER ({w} ROWS UNBOUNDED PRECEDING) AS peak FROM b4),
bm0 AS (SELECT {by}, count(*) AS n, arg_max(equity, ts) AS final_equity, avg(ret) AS m, stddev_samp(ret) AS s, min(equity / peak - 1) AS max_drawdown,
  coalesce(avg(CASE WHEN close > entry THEN 1.0 ELSE 0.0 END) FILTER (side = 'sell'), 0) AS win_rate, count(side) AS num_trades FROM b5 GROUP BY ALL),
bm AS (SELECT * EXCLUDE (n, m, s), final_equity / 1000 - 1 AS total_return, pow(final_equity / 1000, 252 / n) - 1 AS annual_return, pow(1 + m, 252) - 1 AS annual_return_from_mean,
  coalesce(m / nullif(s, 0) * sqrt(252), 0) AS sharpe, s * sqrt(252) AS volatility FROM bm0)"""


_SIG = FC + f", sg AS (SELECT *, {_SIGNALS['signal_threshold'][1]} AS signal FROM fc)"
_BM = "final_equity max_drawdown win_rate total_return annual_return annual_return_from_mean sharpe volatility"


def tested(spark, d):
    return bt.backtest(bt.signal_threshold(fcast(spark, d), 0.001), fee=0.001)


@query("backtest", f"WITH {_SIG}, {_test('model, series_key', 'sg')} SELECT model, series_key, {TS}, state, side, ret, equity FROM b5", "ret equity")
def backtest(spark, d):
    return epoch(tested(spark, d)).select("model", "series_key", "ts", "state", "side", "ret", "equity")


@query("trades", f"WITH {_SIG}, {_test('model, series_key', 'sg')} SELECT model, series_key, {TS}, close AS price, side FROM b5 WHERE side IS NOT NULL", "price")
def trades(spark, d):
    return epoch(bt.trades(tested(spark, d)))


@query("backtest_metrics", f"WITH {_SIG}, {_test('model, series_key', 'sg')} SELECT * FROM bm", _BM)
def backtest_metrics(spark, d):
    return bt.backtest_metrics(tested(spark, d))


_HOLD = f"""hb AS (SELECT *, coalesce(close / lag(close) OVER ({W}) - 1, 0) AS ret, max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM calm),
hg AS (SELECT series_key, count(*) AS n, arg_max(close, ts) / arg_min(close, ts) - 1 AS total_return, avg(ret) AS m, stddev_samp(ret) AS s, min(close / peak - 1) AS max_drawdown FROM hb GROUP BY 1),
hold AS (SELECT series_key, max_drawdown, total_return, 1000 * (1 + total_return) AS final_equity, pow(1 + total_return, 252 / n) - 1 AS annual_return,
  coalesce(m / nullif(s, 0) * sqrt(252), 0) AS sharpe, s * sqrt(252) AS volatility, CASE WHEN total_return > 0 THEN 1.0 ELSE 0.0 END AS win_rate, 1::BIGINT AS num_trades FROM hg)"""


def hold(spark, d):
    return bt.buy_hold_benchmark(calm_bars(spark, d), ["series_key"])


query("buy_hold_benchmark", f"WITH {CALM}, {_HOLD} SELECT * FROM hold", "max_drawdown total_return final_equity annual_return sharpe volatility win_rate")(hold)


_TK = f"""{EVENT_TICKS}, tk AS (SELECT series_key, seq AS ts, 10000 + price AS close, CASE WHEN seq % 7 = 0 THEN 1 WHEN seq % 5 = 0 THEN -1 ELSE 0 END AS signal FROM event_ticks)"""


@query("tick_backtest", f"WITH {_TK}, {_test('series_key', 'tk')} SELECT series_key, ts AS seq, state, side, equity, peak FROM b5", "equity peak", digits=4)
def tick_backtest(spark, d):
    """Back-test on the ticks of hot series: every cumulative step is a two-level scan."""
    seq = F.col("seq")
    t = event_ticks(spark, d).select(
        "series_key", "ts", "seq", (F.col("price") + 10000).alias("close"), F.when(seq % 7 == 0, 1).when(seq % 5 == 0, -1).otherwise(0).alias("signal")
    )
    out = bt.backtest(t, ["series_key"], fee=0.001, order=["seq"], bucket=Slices(6 * 3600, TICKS))
    return out.select("series_key", "seq", "state", "side", "equity", "peak")


# --- strategies x models -------------------------------------------------------------------

_STRATS = {"threshold": "signal_threshold", "directional": "signal_directional", "hybrid": "signal_hybrid", "buy_hold": "signal_buy_hold"}


def results(spark, d):
    """One row of figures per model, strategy and series: all strategies in one back-test pass."""
    f = fcast(spark, d)
    for s, name in _STRATS.items():
        f = _SIGNALS[name][0](f).withColumnRenamed("signal", f"s_{s}")
    return bt.backtests(f, {s: F.col(f"s_{s}") for s in _STRATS}, [0.001]).drop("fee")


_RES = FC + ", sx AS (" + " UNION ALL ".join(f"SELECT model, series_key, ts, close, '{s}' AS strategy, {_SIGNALS[n][1]} AS signal FROM fc" for s, n in _STRATS.items()) + "), " + _test("model, strategy, series_key", "sx")

query("strategy_results", f"WITH {_RES} SELECT * FROM bm", _BM)(results)


@query("model_leaderboard", f"""WITH {_RES} SELECT model, round(avg(total_return), 4) AS avg_total_return, round(avg(sharpe), 4) AS avg_sharpe,
  round(avg(max_drawdown), 4) AS avg_max_drawdown, round(avg(win_rate), 4) AS avg_win_rate FROM bm GROUP BY 1""", "avg_total_return avg_sharpe avg_max_drawdown avg_win_rate")
def model_leaderboard(spark, d):
    return bt.model_leaderboard(results(spark, d))


@query("strategy_stats", f"WITH {_RES} SELECT strategy, avg(total_return) AS mean, stddev_samp(total_return) AS std, max(total_return) AS max, min(total_return) AS min FROM bm GROUP BY 1", "mean std max min")
def strategy_stats(spark, d):
    return bt.strategy_stats(results(spark, d))


@query("metric_pivot", f"WITH {_RES} SELECT model, " + ", ".join(f"avg(total_return) FILTER (strategy = '{s}') AS {s}" for s in _STRATS) + " FROM bm GROUP BY 1", " ".join(_STRATS))
def metric_pivot(spark, d):
    return bt.metric_pivot(results(spark, d), list(_STRATS))


_BEST = """SELECT strategy, model, series_key, {m} FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round({m}, 9) DESC, model, series_key) AS k FROM bm) WHERE k = 1"""
for _m in ("total_return", "sharpe"):

    @query(f"best_per_strategy_{_m}", f"WITH {_RES} {_BEST.format(m=_m)}", _m)
    def best_per_strategy(spark, d, m=_m):
        return bt.best_per_strategy(results(spark, d).withColumn(m, F.round(m, 9)), m)


@query("beat_benchmark", f"""WITH {_RES}, {_HOLD} SELECT strategy, count(*) AS n, sum(CASE WHEN b.total_return > h.total_return THEN 1 ELSE 0 END)::BIGINT AS n_beats,
  avg(CASE WHEN b.total_return > h.total_return THEN 1.0 ELSE 0.0 END) AS share_beats, count(*) FILTER (b.total_return > 0.05) AS n_high
FROM bm b JOIN hold h USING (series_key) GROUP BY 1""", "share_beats")
def beat_benchmark(spark, d):
    return bt.beat_benchmark(results(spark, d), hold(spark, d), high=0.05)


# --- sweep ---------------------------------------------------------------------------------

CONF, FEES, CHANGES = [0.0, 0.0005, 0.001, 0.002, 0.005, 0.01], [0.0, 0.001, 0.002], [0.0, 0.005, 0.01, 0.02, 0.05]


def swept(spark, d):
    return bt.sweep(fcast(spark, d), CONF, FEES, CHANGES)


_SW = FC + f""", mv AS (SELECT *, predicted / lag(predicted) OVER ({FW}) - 1 AS move FROM fc),
sv AS (SELECT *, coalesce(CASE WHEN move > confidence THEN 1 WHEN move < -confidence THEN -1 ELSE 0 END, 0) AS signal
  FROM mv, (VALUES {', '.join(f'({c}::DOUBLE)' for c in CONF)}) AS c(confidence), (VALUES {', '.join(f'({f}::DOUBLE)' for f in FEES)}) AS f(fee)),
{_test('model, series_key, confidence, fee', 'sv', 'fee')}, sw AS (SELECT * FROM bm, (VALUES {', '.join(f'({c}::DOUBLE)' for c in CHANGES)}) AS h(change))"""
query("sweep", f"WITH {_SW} SELECT * FROM sw", _BM + " confidence fee change")(swept)

_TOP = """(SELECT *, '{r}' AS ranking, round({x}, 6) AS score FROM sw ORDER BY score DESC NULLS LAST, model, series_key, confidence, fee, change LIMIT 10)"""


@query("top_k_sweep", f"WITH {_SW} SELECT ranking, model, series_key, confidence, fee, change, score FROM (" + " UNION ALL ".join(
    f"SELECT * FROM {_TOP.format(r=r, x=x)}" for r, x in (("return", "total_return"), ("sharpe", "sharpe"), ("combined", "total_return / nullif(abs(max_drawdown), 0) * sharpe"))) + ")",
    "confidence fee change score")
def top_k_sweep(spark, d):
    return bt.top_k_sweep(swept(spark, d), digits=6).select("ranking", "model", "series_key", "confidence", "fee", "change", "score")


@query("sweep_beats_baseline", f"WITH {_SW} SELECT model, series_key, confidence, fee, change, total_return, sharpe FROM sw WHERE total_return > 0.02 AND sharpe > 0.5", "confidence fee change total_return sharpe")
def sweep_beats_baseline(spark, d):
    return bt.sweep_beats(swept(spark, d), 0.02, 0.5).select("model", "series_key", "confidence", "fee", "change", "total_return", "sharpe")


@query("param_sensitivity", f"WITH {_SW}, u AS (" + " UNION ALL ".join(f"SELECT '{p}' AS param, {p} AS setting, total_return, sharpe FROM sw" for p in ("confidence", "fee", "change")) + """)
SELECT param, setting, avg(total_return) AS mean_total_return, stddev_samp(total_return) AS std_total_return, max(total_return) AS max_total_return,
  avg(sharpe) AS mean_sharpe, stddev_samp(sharpe) AS std_sharpe, max(sharpe) AS max_sharpe FROM u GROUP BY 1, 2""",
       "setting mean_total_return std_total_return max_total_return mean_sharpe std_sharpe max_sharpe")
def param_sensitivity(spark, d):
    return bt.param_sensitivity(swept(spark, d), ["confidence", "fee", "change"])


@query("shift_prediction_time", f"""WITH {FC}, c AS (SELECT model, series_key, avg(epoch(nx) - epoch(ts)) AS c FROM (SELECT *, lead(ts) OVER ({FW}) AS nx FROM fc) GROUP BY 1, 2)
SELECT model, series_key, {TS}, floor(epoch(ts) + c * 3)::BIGINT AS prediction_ts, CASE WHEN t % 50 = 0 THEN close ELSE predicted END AS predicted FROM fc JOIN c USING (model, series_key)""", "predicted")
def shift_prediction_time(spark, d):
    f = fcast(spark, d).withColumn("predicted", F.when(F.col("t") % 50 != 0, F.col("predicted")))
    return epoch(bt.shift_prediction_time(f, 3)).select("model", "series_key", "ts", "prediction_ts", "predicted")


# --- flagship ------------------------------------------------------------------------------

@query("flagship_leaderboard", f"""WITH {CALM}, x AS (SELECT *, CASE WHEN count(close) OVER ({W} ROWS 19 PRECEDING) = 20 THEN avg(close) OVER ({W} ROWS 19 PRECEDING) END AS m FROM calm),
s AS (SELECT *, CASE WHEN close > m THEN 1 ELSE -1 END AS signal FROM x), {_test('series_key', 's')}, {_HOLD}
SELECT series_key, bm.total_return, bm.sharpe, bm.max_drawdown, bm.win_rate, bm.num_trades, h.total_return AS hold_return FROM bm JOIN hold h USING (series_key)
ORDER BY round(bm.total_return, 6) DESC, series_key LIMIT 10""", "total_return sharpe max_drawdown win_rate hold_return")
def flagship_leaderboard(spark, d):
    """Ticks to daily bars, 20-day trend signal, back-test with fee, against buy and hold: top ten."""
    b = ind.add_features(calm_bars(spark, d), [ind.moving_average_features((20,)), ind.rsi_features((14,))])
    b = b.withColumn("signal", F.when(F.col("close") > F.col("sma_20"), 1).otherwise(-1))
    m = bt.backtest_metrics(bt.backtest(b, ["series_key"], fee=0.001), ["series_key"])
    m = m.join(hold(spark, d).select("series_key", F.col("total_return").alias("hold_return")), "series_key")
    top = m.orderBy(F.desc(F.round("total_return", 6)), "series_key").limit(10)
    return top.select("series_key", "total_return", "sharpe", "max_drawdown", "win_rate", "num_trades", "hold_return")


# --- forecasts -----------------------------------------------------------------------------

def _base_sql(frame: str, off: int) -> str:
    """Window figures in SQL; the regression is centred on the row."""
    lags = ", ".join(f"lag(close, {k + off - 1}) OVER ({W}) AS lag{k}" for k in range(1, 8))
    return f"""i0 AS (SELECT series_key, ts, close, row_number() OVER ({W})::DOUBLE AS i FROM calm),
w0 AS (SELECT *, count(*) OVER f AS n, lag(close, {off}) OVER ({W}) AS last, avg(close) OVER f AS mean, regr_slope(close, i) OVER f AS b, regr_intercept(close, i) OVER f AS a, {lags},
  lead(ts) OVER ({W}) AS nx FROM i0 WINDOW f AS ({W} ROWS BETWEEN {frame}))"""


def _steps_sql(shift: int, where: str, ts: str) -> str:
    rows = []
    for h in (1, 2, 3):
        k = 7 - (h - 1) % 7
        line = f"(a + b * (i + {h + shift - 1}))"
        at = f"(a + b * (i + {shift} - {k}))"
        for m, x in (("naive", "last"), ("seasonal_naive", f"lag{k}"), ("mean", "mean"), ("linear_trend", line), ("decomposed_linear", f"{line} + lag{k} - {at}")):
            rows.append(f"SELECT series_key, {ts.format(h=h)} AS ts, '{m}' AS model, {h} AS horizon, {x} AS predicted FROM w0 WHERE n = 24 AND {where}")
    return " UNION ALL ".join(rows)


@query("rolling_forecast", f"WITH {CALM}, {_base_sql('24 PRECEDING AND 1 PRECEDING', 1)} {_steps_sql(0, 'true', 'epoch(ts)::BIGINT')}", "predicted", digits=4)
def rolling_forecast(spark, d):
    return epoch(fc.rolling_forecast(calm_bars(spark, d).select("series_key", "ts", "close")))


@query("forecast_latest", f"WITH {CALM}, {_base_sql('23 PRECEDING AND CURRENT ROW', 0)} {_steps_sql(1, 'nx IS NULL', '(epoch(ts) + {h} * 86400)::BIGINT')}", "predicted", digits=4)
def forecast_latest(spark, d):
    return epoch(fc.forecast_latest(calm_bars(spark, d)))


@query("walk_forward", f"""WITH {CALM}, p AS (SELECT *, row_number() OVER ({W}) - 1 AS rn FROM calm), l AS (SELECT series_key, count(*) AS n FROM calm GROUP BY 1), f AS ({WALK_SQL}),
m AS (SELECT p.series_key, fold, avg(close) AS predicted FROM p JOIN f ON p.series_key = f.series_key AND role = 'train' AND rn >= hi - 20 AND rn < hi GROUP BY 1, 2)
SELECT p.series_key, f.fold, {TS}, close AS actual, m.predicted FROM p JOIN f ON p.series_key = f.series_key AND role = 'val' AND rn >= lo AND rn < hi
JOIN m ON m.series_key = f.series_key AND m.fold = f.fold""", "actual predicted")
def walk_forward(spark, d):
    """User model (mean of the last 20 training closes) on every walk-forward window."""

    def model(train, val):
        return [train["close"].tail(20).mean()] * len(val)

    p = sp.positioned(calm_bars(spark, d).select("series_key", "ts", "close"))
    windows = sp.walk_forward_windows(sp.series_lengths(calm_bars(spark, d)), 200, 60, 24)
    return epoch(fc.walk_forward(p, windows, model))


# --- ensembles -----------------------------------------------------------------------------

_WT = FORECASTS + """, ms AS (SELECT series_key, model, avg(pow(predicted - actual, 2)) AS mse FROM forecasts GROUP BY 1, 2),
wt AS (SELECT *, (1 / mse) / sum(1 / mse) OVER (PARTITION BY series_key) AS weight FROM ms),
en AS (SELECT series_key, ts, max(actual) AS actual, sum(weight * predicted) AS predicted FROM forecasts JOIN wt USING (series_key, model) GROUP BY 1, 2)"""


@query("ensemble_inverse_mse", f"""WITH {_WT}, e AS (SELECT series_key, avg(pow(predicted - actual, 2)) AS ensemble_mse FROM en GROUP BY 1),
b AS (SELECT series_key, min(mse) AS best_mse FROM ms GROUP BY 1)
SELECT series_key, ensemble_mse, best_mse, (best_mse - ensemble_mse) / best_mse * 100 AS improvement FROM e JOIN b USING (series_key)""", "ensemble_mse best_mse improvement", digits=4)
def ensemble_inverse_mse(spark, d):
    f = forecasts(spark, d)
    return fc.ensemble_improvement(f, fc.inverse_mse_weights(f))


@query("ensemble_weights", f"WITH {_WT} SELECT series_key, model, mse, weight FROM wt", "mse weight", digits=4)
def ensemble_weights(spark, d):
    return fc.inverse_mse_weights(forecasts(spark, d))


@query("ensemble_apply", f"WITH {_WT} SELECT series_key, {TS}, actual, predicted FROM en", "actual predicted")
def ensemble_apply(spark, d):
    f = forecasts(spark, d)
    return epoch(fc.ensemble_apply(f, fc.inverse_mse_weights(f)))


@query("ensemble_eval", f"""WITH {_WT}, c AS (SELECT *, actual - lag(actual) OVER ({W}) AS da, predicted - lag(predicted) OVER ({W}) AS dp FROM en)
SELECT series_key, avg(pow(predicted - actual, 2)) AS mse, avg(abs(predicted - actual)) AS mae, avg(abs((predicted - actual) / actual)) AS mape,
  avg(CASE WHEN sign(dp) = sign(da) THEN 1.0 WHEN da IS NOT NULL THEN 0.0 END) AS directional_accuracy FROM c GROUP BY 1""", "mse mae mape directional_accuracy", digits=4)
def ensemble_eval(spark, d):
    f = forecasts(spark, d)
    return fc.ensemble_eval(fc.ensemble_apply(f, fc.inverse_mse_weights(f)))


@query("ensemble_grid", f"""WITH {FORECASTS}, p AS (SELECT series_key, ts, {', '.join(f"max(predicted - actual) FILTER (model = '{m}') AS e{i}" for i, m in enumerate(MODELS))} FROM forecasts GROUP BY 1, 2),
mm AS (SELECT series_key, {', '.join(f'avg(e{i} * e{j}) AS m{i}{j}' for i in range(3) for j in range(i, 3))} FROM p GROUP BY 1),
g AS (SELECT a / 10.0::DOUBLE AS w0, b / 10.0::DOUBLE AS w1, (10 - a - b) / 10.0::DOUBLE AS w2 FROM range(11) x(a), range(11) y(b) WHERE a + b <= 10),
r AS (SELECT *, round({' + '.join(f'w{i} * w{j} * m{i}{j}' + ('' if i == j else ' * 2') for i in range(3) for j in range(i, 3))}, 9) AS mse FROM mm, g)
SELECT series_key, mse, w0 AS weight_naive, w1 AS weight_mean10, w2 AS weight_trend5 FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY mse, w0, w1, w2) AS k FROM r) WHERE k = 1""",
       "mse weight_naive weight_mean10 weight_trend5", digits=4)
def ensemble_grid(spark, d):
    return fc.ensemble_grid(forecasts(spark, d), MODELS)


for _keep, _name in ((0.9, "ensemble_ema_score"), (0.85, "ensemble_ema_score_85")):

    @query(_name, f"""WITH {FORECASTS}, e AS (SELECT model, series_key, ts, t, 1 / (1 + pow((predicted - actual) / 100, 2)) AS x, row_number() OVER ({FW}) AS rn FROM forecasts)
SELECT a.model, a.series_key, epoch(a.ts)::BIGINT AS ts, sum(b.x * CASE WHEN b.rn = 1 THEN 1.0 ELSE {1 - _keep:.2f} END * pow({_keep}, a.rn - b.rn)) AS performance
FROM e a JOIN e b ON a.model = b.model AND a.series_key = b.series_key AND b.rn <= a.rn GROUP BY 1, 2, 3""", "performance")
    def ensemble_ema_score(spark, d, keep=_keep):
        e = forecasts(spark, d).withColumn("mse", F.pow((F.col("predicted") - F.col("actual")) / 100, F.lit(2.0)))
        return epoch(fc.performance_ema(e, ["model", "series_key"], keep=keep)).select("model", "series_key", "ts", "performance")


@query("prediction_interval", f"""WITH {FORECASTS} SELECT series_key, {TS}, avg(predicted) AS mean, avg(predicted) - 1.96 * stddev_samp(predicted) AS lower, avg(predicted) + 1.96 * stddev_samp(predicted) AS upper,
  avg(predicted) - stddev_samp(predicted) AS lower_1, avg(predicted) + stddev_samp(predicted) AS upper_1 FROM forecasts GROUP BY series_key, forecasts.ts""", "mean lower upper lower_1 upper_1", digits=4)
def prediction_interval(spark, d):
    """The models of a time stand in for samples."""
    return epoch(fc.prediction_interval(forecasts(spark, d), ["series_key", "ts"]))


def _level(spark, d, step: int):
    f = forecasts(spark, d)
    pos = F.floor((F.col("t") - 11) / step)
    return f.groupBy("model", "series_key", pos.alias("step")).agg(F.max("predicted").alias("predicted"))


@query("reconcile", f"""WITH {FORECASTS}, lv AS (SELECT model, series_key, t - 11 AS u, predicted FROM forecasts),
h AS (SELECT model, series_key, u AS step, predicted FROM lv),
f0 AS (SELECT model, series_key, u // 4 AS step, max(predicted) AS predicted FROM lv GROUP BY ALL), d0 AS (SELECT model, series_key, u // 24 AS step, max(predicted) AS predicted FROM lv GROUP BY ALL),
f1 AS (SELECT f0.model, f0.series_key, f0.step, CASE WHEN up IS NULL THEN predicted ELSE 0.7 * predicted + 0.3 * up END AS predicted FROM f0 LEFT JOIN (
  SELECT model, series_key, step // 4 AS step, avg(predicted) AS up FROM h GROUP BY ALL HAVING count(*) = 4) USING (model, series_key, step)),
d1 AS (SELECT d0.model, d0.series_key, d0.step, CASE WHEN up IS NULL THEN predicted ELSE 0.7 * predicted + 0.3 * up END AS predicted FROM d0 LEFT JOIN (
  SELECT model, series_key, step // 6 AS step, avg(predicted) AS up FROM f1 GROUP BY ALL HAVING count(*) = 6) USING (model, series_key, step))
SELECT '4h' AS level, model, series_key, step::BIGINT AS step, predicted FROM f1 UNION ALL SELECT '1D', model, series_key, step::BIGINT, predicted FROM d1""", "predicted")
def reconcile(spark, d):
    levels = {"1h": _level(spark, d, 1), "4h": _level(spark, d, 4), "1D": _level(spark, d, 24)}
    out = fc.reconcile(levels, {("1h", "4h"): 4, ("4h", "1D"): 6}, ["model", "series_key"])
    cols = ["model", "series_key", "step", "predicted"]
    return out["4h"].select(F.lit("4h").alias("level"), *cols).unionByName(out["1D"].select(F.lit("1D").alias("level"), *cols))


@query("horizon_consistency", f"""WITH {FORECASTS} SELECT a.series_key, avg(pow(a.predicted - b.predicted, 2)) AS consistency_mse, count(*) AS n
FROM forecasts a JOIN forecasts b ON a.series_key = b.series_key AND a.ts = b.ts AND a.model = 'naive' AND b.model = 'trend5' GROUP BY 1""", "consistency_mse", digits=4)
def horizon_consistency(spark, d):
    f = forecasts(spark, d)
    return fc.horizon_consistency(f.where("model = 'naive'"), f.where("model = 'trend5'"), ["series_key", "ts"])

