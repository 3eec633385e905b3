"""Queries: forecast errors, trading and risk figures, panel scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.metrics import COMBINATIONS
from tideline.operators import evaluation as ev
from tideline.operators import splits as sp
from tideline.plans.inputs import CALM, FORECASTS, calm_bars, epoch, forecasts
from tideline.plans.registry import query
from tideline.plans.splits import PANEL, panel

FW = "PARTITION BY model, series_key ORDER BY ts"
E = "(predicted - actual)"
CH = FORECASTS + f""", ch AS (SELECT *, actual - lag(actual) OVER ({FW}) AS da, predicted - lag(predicted) OVER ({FW}) AS dp FROM forecasts),
st AS (SELECT model, series_key, avg(actual) AS ma, avg(predicted) AS mp, quantile_cont(abs{E}, 0.75) AS delta FROM forecasts GROUP BY 1, 2),
rows AS (SELECT * FROM ch JOIN st USING (model, series_key))"""


def share(cond: str) -> str:
    return f"avg(CASE WHEN {cond} THEN 1.0 WHEN da IS NOT NULL AND dp IS NOT NULL THEN 0.0 END)"


MAE, MIS = f"avg(abs{E})", share("sign(dp) <> sign(da)")
SQL = {
    "mae": MAE, "mse": f"avg({E} * {E})", "rmse": f"sqrt(avg({E} * {E}))", "mape": f"avg(abs({E} / actual))", "mspe": f"avg(pow({E} / actual, 2))",
    "mape_eps": f"avg(abs({E} / CASE WHEN abs(actual) < 1e-8 THEN 1e-8 ELSE actual END))",
    "rse": f"sqrt(sum({E} * {E})) / sqrt(var_pop(actual) * count(*))", "r2": f"1 - sum({E} * {E}) / (var_pop(actual) * count(*))",
    "corr_ratio": "sum((actual - ma) * (predicted - mp)) / sqrt(sum(pow(actual - ma, 2) * pow(predicted - mp, 2)))",
    "mda": share("dp * da > 0"), "directional_accuracy": share("sign(dp) = sign(da)"), "sharpe_metric": "avg(dp) / (stddev_samp(dp) + 1e-8)",
    "sharpe_loss": "-(avg(dp) / (stddev_samp(dp) + 1e-8))", "madl": "avg(-sign(actual * predicted) * abs(actual))",
    "gmadl": "avg(-(1 / (1 + exp(-(actual * predicted))) - 0.5) * abs(actual))", "dlf": f"0.5 * {MIS} + 0.5 * {MAE}",
    "asymmetric_loss": f"avg(CASE WHEN {E} < 0 THEN 0.7 * abs{E} ELSE 0.3 * {E} END)",
    "quantile_loss": "(" + " + ".join(f"avg(greatest({q} * (actual - predicted), {q - 1:.1f} * (actual - predicted)))" for q in (0.1, 0.5, 0.9)) + ") / 3",
    "trading_loss": f"0.5 * {MAE} + 0.5 * {MIS} + 0.001 * avg(abs(sign(dp)))",
    "robust_huber": f"avg(CASE WHEN abs{E} <= delta THEN 0.5 * {E} * {E} ELSE delta * (abs{E} - 0.5 * delta) END)",
}
GROUPS = {
    "error_metrics": ["mae", "mse", "rmse", "mape", "mspe", "mape_eps"],
    "fit_metrics": ["rse", "r2", "corr_ratio"],
    "directional_metrics": ["mda", "directional_accuracy", "sharpe_metric", "sharpe_loss"],
    "directional_losses": ["madl", "gmadl", "dlf"],
    "shaped_losses": ["asymmetric_loss", "quantile_loss", "trading_loss", "robust_huber"],
}


def _metrics(name: str, names: list[str]):
    @query(name, f"WITH {CH} SELECT model, series_key, {', '.join(f'{SQL[n]} AS {n}' for n in names)} FROM rows GROUP BY 1, 2", " ".join(names), digits=4)
    def run(spark, d):
        return ev.evaluate(forecasts(spark, d), names)


for _name, _names in {**{n: [n] for n in SQL}, **GROUPS}.items():
    _metrics(_name, _names)

_LOSSES = sorted({x for xs in COMBINATIONS.values() for x in xs})


@query("weighted_loss", f"WITH {CH}, m AS (SELECT model, series_key, {', '.join(f'{SQL[n]} AS {n}' for n in _LOSSES)} FROM rows GROUP BY 1, 2) SELECT model, series_key, "
       + ", ".join(f"({' + '.join(xs)}) / {len(xs)} AS {n}" for n, xs in COMBINATIONS.items()) + " FROM m", " ".join(COMBINATIONS), digits=4)
def weighted_loss(spark, d):
    return ev.weighted_losses(ev.evaluate(forecasts(spark, d), _LOSSES)).select("model", "series_key", *COMBINATIONS)


@query("accuracy", f"WITH {CH} SELECT model, avg(CASE WHEN sign(dp) = sign(da) THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM ch WHERE da IS NOT NULL GROUP BY 1", "accuracy")
def accuracy(spark, d):
    c = ev.with_changes(forecasts(spark, d)).where("d_actual IS NOT NULL")
    return c.groupBy("model").agg(F.avg(F.when(F.signum("d_predicted") == F.signum("d_actual"), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))


# --- loss histories: absolute error per model over time ------------------------------------

def history(spark, d):
    f = forecasts(spark, d)
    return f.select("series_key", F.col("model").alias("loss_name"), F.col("t").alias("step"), (F.abs(F.col("predicted") - F.col("actual")) / 100).alias("value"))


HIST = FORECASTS + f", hist AS (SELECT series_key, model AS loss_name, t AS step, abs{E} / 100 AS value FROM forecasts)"


@query("loss_weights", f"""WITH {HIST}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_key, loss_name ORDER BY step DESC) AS k FROM hist) WHERE k <= 10),
s AS (SELECT series_key, loss_name, avg(value) + 0.1 * abs(arg_max(value, step) - arg_min(value, step)) + 0.05 * stddev_pop(value) AS score, count(value) AS k FROM r GROUP BY 1, 2),
i AS (SELECT *, max(score) OVER p - score + min(score) OVER p AS inv, count(*) OVER p AS m FROM s WINDOW p AS (PARTITION BY series_key)),
l AS (SELECT *, least(greatest(0.7 / m + 0.3 * inv / sum(inv) OVER p, 0.05), 0.8) AS lim FROM i WINDOW p AS (PARTITION BY series_key))
SELECT series_key, loss_name, score, CASE WHEN min(k) OVER (PARTITION BY series_key) < 10 THEN 1.0 / m ELSE lim / sum(lim) OVER (PARTITION BY series_key) END AS weight FROM l""", "score weight")
def loss_weights(spark, d):
    return ev.loss_weights(history(spark, d))


@query("history_summary", f"""WITH {HIST} SELECT series_key, loss_name, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  arg_max(value, step) - arg_min(value, step) AS trend, arg_max(value, step) AS final,
  (arg_min(value, step) - arg_max(value, step)) / nullif(arg_min(value, step), 0) * 100 AS improvement_pct FROM hist GROUP BY 1, 2""",
       "mean std min max trend final improvement_pct", digits=4)
def history_summary(spark, d):
    return ev.history_summary(history(spark, d))


# --- trading -------------------------------------------------------------------------------

def _net(by: str, source: str = "forecasts") -> str:
    w = f"PARTITION BY {by} ORDER BY ts"
    return f"""l1 AS (SELECT *, lead(actual) OVER ({w}) / actual - 1 AS ret, sign(lead(predicted) OVER ({w}) - predicted) AS dir,
  sign(lead(predicted, 2) OVER ({w}) - lead(predicted) OVER ({w})) AS nd FROM {source}),
l2 AS (SELECT *, dir * ret AS gross, abs(nd - dir) * 0.001 AS paid, dir * ret - abs(nd - dir) * 0.001 AS net FROM l1 WHERE nd IS NOT NULL),
l3 AS (SELECT *, product(1 + net) OVER ({w} ROWS UNBOUNDED PRECEDING) AS cum FROM l2),
l4 AS (SELECT *, max(cum) OVER ({w} ROWS UNBOUNDED PRECEDING) AS peak FROM l3)"""


def _trading(by: str) -> str:
    return f"""g AS (SELECT {by}, count(*) AS n, arg_max(cum, ts) - 1 AS total_return, stddev_pop(net) AS sd, avg(net) AS mn, min((cum - peak) / peak) AS max_drawdown,
  stddev_pop(net) FILTER (net < 0) AS dn, coalesce(avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0.0 END) FILTER (dir <> 0), 0) AS win_rate,
  coalesce(avg(gross) FILTER (dir <> 0 AND gross > 0), 0) AS avg_win, coalesce(avg(gross) FILTER (dir <> 0 AND gross < 0), 0) AS avg_loss,
  count(*) FILTER (dir <> 0) AS total_trades, sum(paid) AS transaction_cost_impact FROM l4 GROUP BY ALL),
h AS (SELECT *, pow(1 + total_return, 252 / n) - 1 AS annualized_return, sd * sqrt(252) AS annualized_volatility FROM g),
tm AS (SELECT * EXCLUDE (n, sd, mn, dn), coalesce(annualized_return / nullif(annualized_volatility, 0), 0) AS sharpe_ratio,
  coalesce(annualized_return / nullif(dn * sqrt(252), 0), 0) AS sortino_ratio, coalesce(annualized_return / nullif(abs(max_drawdown), 0), 0) AS calmar_ratio,
  coalesce(mn * 252 / nullif(annualized_volatility, 0), 0) AS information_ratio, coalesce(abs(avg_win / nullif(avg_loss, 0)), 0) AS profit_factor FROM h)"""


_TCOLS = "total_return max_drawdown win_rate avg_win avg_loss transaction_cost_impact annualized_return annualized_volatility sharpe_ratio sortino_ratio calmar_ratio information_ratio profit_factor"


@query("trading_metrics", f"WITH {FORECASTS}, {_net('model, series_key')}, {_trading('model, series_key')} SELECT * FROM tm", _TCOLS)
def trading_metrics(spark, d):
    return ev.trading_metrics(forecasts(spark, d), per_year=252)


@query("window_trading_metrics", f"""WITH {FORECASTS}, v AS (SELECT *, (t - 1) // 100 AS window_id FROM forecasts), {_net('model, series_key, window_id', 'v')}
SELECT model, series_key, window_id, coalesce(sqrt(8760) * avg(net) / nullif(stddev_pop(net), 0), 0) AS sharpe_ratio, min((cum - peak) / peak) AS max_drawdown,
  avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(sum(net) FILTER (net > 0) / nullif(abs(sum(net) FILTER (net < 0)), 0), 0) AS profit_factor
FROM l4 GROUP BY 1, 2, 3""", "sharpe_ratio max_drawdown win_rate profit_factor", digits=4)
def window_trading_metrics(spark, d):
    """Validation windows of 100 rows, each judged on its own."""
    v = forecasts(spark, d).withColumn("window_id", F.floor((F.col("t") - 1) / 100))
    return ev.window_trading_metrics(v, ["model", "series_key", "window_id"])


@query("var_es", f"""WITH {FORECASTS}, {_net('model, series_key')}, q AS (SELECT model, series_key, quantile_cont(net, 0.05) AS v5, quantile_cont(net, 0.01) AS v1 FROM l2 GROUP BY 1, 2)
SELECT model, series_key, max(v5) AS var_95, max(v1) AS var_99, avg(net) FILTER (net <= v5) AS expected_shortfall FROM l2 JOIN q USING (model, series_key) GROUP BY 1, 2""",
       "var_95 var_99 expected_shortfall")
def var_es(spark, d):
    return ev.value_at_risk(ev.strategy_returns(forecasts(spark, d)), "net", ["model", "series_key"])


@query("regime_metrics", f"""WITH {FORECASTS}, v AS (SELECT *, CASE WHEN t % 20 < 9 THEN 'calm' WHEN t % 20 < 18 THEN 'busy' ELSE 'rare' END AS regime FROM forecasts),
{_net('model, series_key, regime', 'v')}, {_trading('model, series_key, regime')}, z AS (SELECT model, series_key, regime, count(*) AS regime_periods FROM v GROUP BY 1, 2, 3),
y AS (SELECT *, regime_periods / sum(regime_periods) OVER (PARTITION BY model, series_key) * 100 AS regime_percentage FROM z)
SELECT * FROM tm JOIN y USING (model, series_key, regime) WHERE regime_periods > 10""", _TCOLS + " regime_percentage")
def regime_metrics(spark, d):
    r = F.col("t") % 20
    v = forecasts(spark, d).withColumn("regime", F.when(r < 9, "calm").when(r < 18, "busy").otherwise("rare"))
    return ev.regime_metrics(v, per_year=252)


def scored(spark, d):
    """Errors and trading figures of every model per series, with the overall score."""
    f = forecasts(spark, d)
    e = ev.evaluate(f, ["mape", "r2"]).withColumn("mape", F.col("mape") * 100)
    m = e.join(ev.trading_metrics(f, per_year=252), ["model", "series_key"])
    return m.withColumn("score", ev.model_score())


_SC = f"""{CH}, e AS (SELECT model, series_key, {SQL['mape']} * 100 AS mape, {SQL['r2']} AS r2 FROM rows GROUP BY 1, 2), {_net('model, series_key')}, {_trading('model, series_key')},
sc AS (SELECT *, 0.2 * greatest(0, 1 - mape / 100) + 0.2 * greatest(0, r2) + 0.3 * least(1, greatest(0, sharpe_ratio / 2)) + 0.2 * least(1, win_rate)
  + 0.1 * greatest(0, 1 + max_drawdown / 0.5) AS score FROM e JOIN tm USING (model, series_key))"""


@query("model_score", f"WITH {_SC} SELECT model, series_key, mape, r2, sharpe_ratio, win_rate, max_drawdown, score FROM sc", "mape r2 sharpe_ratio win_rate max_drawdown score")
def model_score(spark, d):
    return scored(spark, d).select("model", "series_key", "mape", "r2", "sharpe_ratio", "win_rate", "max_drawdown", "score")


@query("model_ranking", f"""WITH {_SC}, k AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY score DESC, model)::INT AS place FROM sc)
SELECT series_key, model, place, (sharpe_ratio >= 0.5)::INT AS sharpe_ok, (win_rate >= 0.45)::INT AS win_rate_ok, (abs(max_drawdown) <= 0.2)::INT AS drawdown_ok,
  CASE WHEN place <= 3 THEN concat_ws(', ', CASE WHEN sharpe_ratio > 1 THEN 'risk-adjusted return' END, CASE WHEN win_rate > 0.6 THEN 'win rate' END,
    CASE WHEN abs(max_drawdown) < 0.1 THEN 'drawdown' END) END AS strengths FROM k""")
def model_ranking(spark, d):
    r = ev.model_ranking(scored(spark, d), ["series_key"])
    return r.select("series_key", "model", "place", "sharpe_ok", "win_rate_ok", "drawdown_ok", "strengths")


@query("dataset_label", """SELECT p_partkey, CASE WHEN contains(upper(name), 'EXTERNAL') THEN 'EXTERNAL' WHEN contains(upper(name), 'MULTISCALE') THEN 'MULTISCALE'
  WHEN contains(upper(name), 'ENHANCED') THEN 'ENHANCED' ELSE 'BASIC' END AS dataset FROM (
  SELECT p_partkey, p_name || CASE p_size % 4 WHEN 0 THEN '_External' WHEN 1 THEN '_multiscale' WHEN 2 THEN '_Enhanced' ELSE '' END AS name FROM part)""")
def dataset_label(spark, d):
    from tideline.plans.inputs import table

    r = F.col("p_size") % 4
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(r == 0, "_External").when(r == 1, "_multiscale").when(r == 2, "_Enhanced").otherwise("")).alias("model"))
    return p.select("p_partkey", ev.dataset_label().alias("dataset"))


@query("cv_aggregate", f"""WITH {FORECASTS}, f AS (SELECT model, series_key, ((t - 1) // 100)::BIGINT AS fold, avg(abs{E}) AS mae, count(*) AS n_test FROM forecasts GROUP BY 1, 2, 3)
SELECT model, series_key, avg(mae) AS mean, quantile_cont(mae, 0.5) AS median, sum(mae * n_test) / sum(n_test) AS weighted_mean, stddev_pop(mae) AS std,
  arg_min(fold, mae) AS best_fold, arg_max(fold, mae) AS worst_fold FROM f GROUP BY 1, 2""", "mean median weighted_mean std", digits=4)
def cv_aggregate(spark, d):
    from tideline.functions.metrics import mae

    f = forecasts(spark, d).withColumn("fold", F.floor((F.col("t") - 1) / 100)).groupBy("model", "series_key", "fold").agg(mae().alias("mae"), F.count("*").alias("n_test"))
    return ev.cv_aggregate(f, "mae", ["model", "series_key"])


@query("point_adjust", f"""WITH {CALM}, b AS (SELECT series_key, ts, row_number() OVER w AS i, CASE WHEN close > lag(close) OVER w THEN 1 ELSE 0 END AS truth,
  CASE WHEN volume > 45 THEN 1 ELSE 0 END AS hit FROM calm WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
s AS (SELECT *, sum(st) OVER (PARTITION BY series_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS seg FROM (
  SELECT *, CASE WHEN truth <> coalesce(lag(truth) OVER (PARTITION BY series_key ORDER BY ts), -1) THEN 1 ELSE 0 END AS st FROM b))
SELECT series_key, epoch(ts)::BIGINT AS ts, truth, hit, CASE WHEN truth = 1 AND i > 1 THEN max(hit) OVER (PARTITION BY series_key, seg) ELSE hit END AS adjusted FROM s""")
def point_adjust(spark, d):
    from tideline.functions.rolling import series_window

    w = series_window(["series_key"])
    b = calm_bars(spark, d).select(
        "series_key", "ts", F.when(F.col("close") > F.lag("close").over(w), 1).otherwise(0).alias("truth"), F.when(F.col("volume") > 45, 1).otherwise(0).alias("hit")
    )
    return epoch(ev.point_adjust(b, ["series_key"], ["ts"]))


# --- panel scores --------------------------------------------------------------------------

def panel_points(spark, d):
    """Last ten values of each array as target, against the mean and the value of ten steps before."""
    p = panel(spark, d)
    n = F.size("vals")
    mean = sp.array_sum(F.slice("vals", 1, n - 10)) / (n - 10)
    rows = p.withColumns({"__mean": mean, "j": F.explode(F.sequence(F.lit(1), F.lit(10)))})
    return rows.select("series_id", "grp", F.element_at("vals", n - 10 + F.col("j")).alias("actual"), F.col("__mean").alias("predicted"),
                       F.element_at("vals", n - 20 + F.col("j")).alias("naive"))


def panel_scale(spark, d, m: int = 4):
    """Mean absolute difference at the season m before the target part."""
    p = panel(spark, d)
    body = F.slice("vals", 1, F.size("vals") - 10)
    diffs = F.zip_with(F.slice(body, m + 1, F.size(body) - m), F.slice(body, 1, F.size(body) - m), lambda x, y: F.abs(x - y))
    return p.select("series_id", (sp.array_sum(diffs) / F.size(diffs)).alias("naive_mae"))


_PP = PANEL + """, l AS (SELECT series_id, grp, len(vals) AS n, unnest(vals) AS x, generate_subscripts(vals, 1) AS i FROM panel),
pm AS (SELECT series_id, avg(x) FILTER (i <= n - 10) AS m FROM l GROUP BY 1),
pts AS (SELECT a.series_id, a.grp, a.x AS actual, m AS predicted, b.x AS naive, a.i FROM l a JOIN l b ON a.series_id = b.series_id AND b.i = a.i - 10 JOIN pm ON pm.series_id = a.series_id WHERE a.i > a.n - 10),
sc AS (SELECT a.series_id, avg(abs(a.x - b.x)) AS naive_mae FROM l a JOIN l b ON a.series_id = b.series_id AND b.i = a.i - 4 WHERE a.i <= a.n - 10 GROUP BY 1)"""


@query("m4_scores", f"""WITH {_PP}, s AS (SELECT grp, p.series_id, count(*) AS m, sum(200 * abs(predicted - actual) / CASE WHEN abs(actual) + abs(predicted) = 0 THEN 1 ELSE abs(actual) + abs(predicted) END) AS s,
  sum(200 * abs(naive - actual) / CASE WHEN abs(actual) + abs(naive) = 0 THEN 1 ELSE abs(actual) + abs(naive) END) AS zs,
  sum(100 * abs(predicted - actual) / CASE WHEN actual = 0 THEN 1 ELSE abs(actual) END) AS p, avg(abs(predicted - actual)) / max(naive_mae) AS e, avg(abs(naive - actual)) / max(naive_mae) AS ze
  FROM pts p JOIN sc USING (series_id) GROUP BY 1, 2),
g AS (SELECT grp, count(*) AS k, sum(s) / sum(m) AS smape, sum(p) / sum(m) AS mape, avg(e) AS mase, sum(zs) / sum(m) AS nsm, avg(ze) AS nma FROM s GROUP BY 1),
u AS (SELECT CASE WHEN grp IN (0, 1, 2) THEN grp::VARCHAR ELSE 'Others' END AS name, * FROM g UNION ALL SELECT 'Average', * FROM g),
t AS (SELECT name, sum(smape * k) / sum(k) AS smape, sum(mape * k) / sum(k) AS mape, sum(mase * k) / sum(k) AS mase, sum(nsm * k) / sum(k) AS nsm, sum(nma * k) / sum(k) AS nma FROM u GROUP BY 1)
SELECT name, round(smape, 3) AS smape, round(mape, 3) AS mape, round(mase, 3) AS mase, round((mase / nma + smape / nsm) / 2, 3) AS owa FROM t""", "smape mape mase owa", digits=4)
def m4_scores(spark, d):
    return ev.panel_scores(panel_points(spark, d), panel_scale(spark, d), [0, 1, 2])


@query("masked_losses", f"""WITH {_PP}, q AS (SELECT *, CASE WHEN i % 3 = 0 THEN 0.0 ELSE 1.0 END AS mask FROM pts)
SELECT q.series_id, avg(abs((predicted - actual) * coalesce(mask / nullif(actual, 0), 0))) AS mape,
  200 * avg(coalesce(abs(predicted - actual) / nullif(abs(predicted) + abs(actual), 0), 0) * mask) AS smape,
  avg(abs(actual - predicted) * coalesce(mask / nullif(naive_mae, 0), 0)) AS mase FROM q JOIN sc USING (series_id) GROUP BY 1""", "mape smape mase")
def masked_losses(spark, d):
    p = panel(spark, d)
    n = F.size("vals")
    mean = sp.array_sum(F.slice("vals", 1, n - 10)) / (n - 10)
    rows = p.withColumns({"__mean": mean, "i": F.explode(F.sequence(n - 9, n))})
    pts = rows.select("series_id", F.element_at("vals", F.col("i")).alias("actual"), F.col("__mean").alias("predicted"), F.when(F.col("i") % 3 == 0, 0.0).otherwise(1.0).alias("mask"))
    return ev.masked_losses(pts, panel_scale(spark, d), ["series_id"])


