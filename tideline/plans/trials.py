"""Queries: trial-log analytics over orders read as trials; five hot studies."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tideline.operators import selection as sel
from tideline.operators import trials as tr
from tideline.operators.ordered import exact_quantiles
from tideline.plans.inputs import EVENT_TICKS, TRIALS, event_ticks, trials
from tideline.plans.registry import query

S = "PARTITION BY study ORDER BY trial_id"
_RB = TRIALS + f""", rb AS (SELECT study, trial_id, value, min(value) OVER ({S} ROWS UNBOUNDED PRECEDING) AS best_so_far, row_number() OVER ({S}) - 1 AS position FROM trials),
tt AS (SELECT study, count(*) AS total_trials, arg_min(value, trial_id) AS initial_value, arg_max(value, trial_id) AS final_value, min(value) AS best_value,
  stddev_pop(value) / avg(value) AS volatility FROM trials GROUP BY 1)"""


@query("running_best", f"WITH {_RB} SELECT study, trial_id, position, best_so_far FROM rb", "best_so_far")
def running_best(spark, d):
    return tr.running_best(trials(spark, d), width=4096).select("study", "trial_id", "position", "best_so_far")


@query("convergence", f"""WITH {_RB}, g AS (SELECT study, max(position) FILTER (position >= 1 AND position <= total_trials - 10 AND (best_so_far - best_value) / best_so_far > 0.001) AS reached,
  count(*) FILTER (abs(best_so_far - best_value) / best_value <= 0.0001) AS plateau_length FROM rb JOIN tt USING (study) GROUP BY 1)
SELECT study, total_trials, initial_value, final_value, best_value, (initial_value - best_value) / initial_value AS improvement_ratio, coalesce(reached + 10, total_trials)::BIGINT AS convergence_trial,
  plateau_length, volatility FROM tt JOIN g USING (study)""", "initial_value final_value best_value improvement_ratio volatility")
def convergence(spark, d):
    return tr.convergence(trials(spark, d), width=4096)


_GRID = (0.01, 0.02, 0.05, 0.1, 0.2)


@query("convergence_rate", f"""WITH {_RB}, j AS (SELECT *, initial_value - best_value AS dr FROM rb JOIN tt USING (study)),
f AS ({" UNION ALL ".join(f"SELECT study, {i} AS i, coalesce(round(regr_r2(ln(best_so_far - (best_value - {g} * dr)), position::DOUBLE), 9), 0) AS r2, -regr_slope(ln(best_so_far - (best_value - {g} * dr)), position::DOUBLE) AS b, max(best_value) - {g} * max(dr) AS c FROM j GROUP BY 1" for i, g in enumerate(_GRID))})
SELECT study, b AS decay_constant, c AS asymptote, r2 AS r_squared, CASE WHEN r2 > 0.8 THEN 1 ELSE 0 END AS converged FROM (
  SELECT *, row_number() OVER (PARTITION BY study ORDER BY r2 DESC, i) AS k FROM f) WHERE k = 1""", "decay_constant asymptote r_squared")
def convergence_rate(spark, d):
    return tr.convergence_rate(trials(spark, d), grid=_GRID, width=4096)


_CRC = "CASE model " + " ".join(f"WHEN '{m}' THEN {zlib.crc32(m.encode()) % 1000}" for m in "FOP") + " END"


@query("param_importance", f"""WITH {TRIALS} SELECT study, 'layers' AS param, abs(corr(layers::DOUBLE, value)) AS importance FROM trials GROUP BY 1
UNION ALL SELECT study, 'rate', abs(corr(rate, value)) FROM trials GROUP BY 1 UNION ALL SELECT study, 'model', abs(corr(({_CRC})::DOUBLE, value)) FROM trials GROUP BY 1
UNION ALL SELECT DISTINCT study, 'fixed', 0.0 FROM trials""", "importance")
def param_importance(spark, d):
    return tr.param_importance(trials(spark, d))


@query("param_corr_matrix", f"""WITH {TRIALS} SELECT 'layers' AS left_column, 'rate' AS right_column, corr(layers::DOUBLE, rate) AS r FROM trials
UNION ALL SELECT 'layers', 'training_time', corr(layers::DOUBLE, training_time) FROM trials UNION ALL SELECT 'rate', 'training_time', corr(rate, training_time) FROM trials""", "r")
def param_corr_matrix(spark, d):
    return sel.corr_matrix(tr.numeric_params(trials(spark, d), ["layers", "rate"]), ["layers", "rate", "training_time"])


@query("param_impact", f"""WITH {TRIALS}, u AS (SELECT 'layers' AS param, layers AS setting, value FROM trials UNION ALL SELECT 'model', model, value FROM trials UNION ALL SELECT 'fixed', '1', value FROM trials UNION ALL SELECT 'rate', rate::VARCHAR, value FROM trials)
SELECT param, setting, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n, min(value) AS min, max(value) AS max FROM u GROUP BY 1, 2""", "mean std min max")
def param_impact(spark, d):
    return tr.param_impact(trials(spark, d))


@query("value_distribution", f"""WITH {TRIALS}, q AS (SELECT study, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS p90 FROM trials GROUP BY 1)
SELECT study, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, skewness(value) * (count(*) - 2) / sqrt(count(*)::DOUBLE * (count(*) - 1)) AS skewness,
  kurtosis_pop(value) AS kurtosis, max(q25) AS q25, max(md) AS median, max(q75) AS q75, max(q75) - max(q25) AS iqr, count(*) FILTER (value <= p10) AS excellent,
  count(*) FILTER (value > p10 AND value <= q25) AS good, count(*) FILTER (value > q25 AND value <= q75) AS average, count(*) FILTER (value > q75 AND value <= p90) AS poor,
  count(*) FILTER (value > p90) AS very_poor FROM trials JOIN q USING (study) GROUP BY 1""", "mean std min max skewness kurtosis q25 median q75 iqr")
def value_distribution(spark, d):
    return tr.value_distribution(trials(spark, d))


def _dominated(strict: str) -> str:
    return f"EXISTS (SELECT 1 FROM trials b WHERE b.study = a.study AND b.value <= a.value AND b.training_time <= a.training_time AND {strict})"


@query("pareto_front", f"WITH {TRIALS} SELECT study, trial_id, value, training_time FROM trials a WHERE NOT {_dominated('(b.value < a.value OR b.training_time < a.training_time)')}", "value training_time")
def pareto_front(spark, d):
    return tr.pareto_front(trials(spark, d), "value", "training_time").select("study", "trial_id", "value", "training_time")


@query("pareto_front_higher", f"""WITH {TRIALS} SELECT study, trial_id, value, training_time FROM trials a WHERE NOT EXISTS (
  SELECT 1 FROM trials b WHERE b.study = a.study AND b.trial_id <> a.trial_id AND b.value <= a.value AND b.training_time >= a.training_time)""", "value training_time")
def pareto_front_higher(spark, d):
    """Longer training counts as better and equal points eliminate each other."""
    p = tr.pareto_front(trials(spark, d), "value", "training_time", y_low=False, mode="reference")
    return p.select("study", "trial_id", "value", "training_time")


@query("dominance_join", f"WITH {TRIALS} SELECT study, count(*) AS n_dominated FROM trials a WHERE {_dominated('(b.value < a.value OR b.training_time < a.training_time)')} GROUP BY 1")
def dominance_join(spark, d):
    """Points outside the front, as an anti join with it."""
    t = trials(spark, d)
    front = tr.pareto_front(t, "value", "training_time").select("study", "trial_id")
    return t.join(front, ["study", "trial_id"], "left_anti").groupBy("study").agg(F.count("*").alias("n_dominated"))


def _metrics(trials):
    return trials.withColumns({n: F.element_at("params", F.lit(n)).cast("double") for n in ("layers", "rate")})


_GOOD = "b.study = a.study AND b.value <= a.value AND b.training_time <= a.training_time AND b.layers >= a.layers"
_TRIALS3 = f"{TRIALS}, t AS (SELECT study, trial_id, value, training_time, CAST(layers AS DOUBLE) AS layers, rate FROM trials)"


@query("pareto_front_metrics", f"""WITH {_TRIALS3} SELECT study, trial_id, value, training_time, layers FROM t a WHERE NOT EXISTS (
  SELECT 1 FROM t b WHERE {_GOOD} AND (b.value < a.value OR b.training_time < a.training_time OR b.layers > a.layers))""", "value training_time layers")
def pareto_front_metrics(spark, d):
    """Front of three metrics, more layers counting as better."""
    front = tr.skyline(_metrics(trials(spark, d)), {"value": "low", "training_time": "low", "layers": "high"})
    return front.select("study", "trial_id", "value", "training_time", "layers")


@query("pareto_front_metrics_reference", f"""WITH {_TRIALS3} SELECT study, trial_id, value, training_time, layers, rate FROM t a WHERE NOT EXISTS (
  SELECT 1 FROM t b WHERE {_GOOD} AND b.rate >= a.rate AND b.trial_id <> a.trial_id)""", "value training_time layers rate")
def pareto_front_metrics_reference(spark, d):
    """Front of four metrics where equal points eliminate each other."""
    front = tr.skyline(_metrics(trials(spark, d)), {"value": "low", "training_time": "low", "layers": "high", "rate": "high"}, mode="reference")
    return front.select("study", "trial_id", "value", "training_time", "layers", "rate")


@query("dominance_join_metrics", f"""WITH {_TRIALS3} SELECT study, count(*) AS n_dominated, min(value) AS best_dominated FROM t a WHERE EXISTS (
  SELECT 1 FROM t b WHERE {_GOOD} AND (b.value < a.value OR b.training_time < a.training_time OR b.layers > a.layers)) GROUP BY 1""", "best_dominated")
def dominance_join_metrics(spark, d):
    """Points that some other point dominates in three metrics, as an anti join with the front."""
    t = _metrics(trials(spark, d))
    front = tr.skyline(t, {"value": "low", "training_time": "low", "layers": "high"}).select("study", "trial_id")
    return t.join(front, ["study", "trial_id"], "left_anti").groupBy("study").agg(F.count("*").alias("n_dominated"), F.min("value").alias("best_dominated"))


@query("study_summary", f"""WITH {TRIALS} SELECT study, count(*) AS n_trials, count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'pruned') AS pruned, count(*) FILTER (status = 'completed') / count(*) * 100 AS success_rate, min(value) AS best_value FROM trials GROUP BY 1""", "success_rate best_value")
def study_summary(spark, d):
    return tr.study_summary(trials(spark, d))


@query("method_compare", f"""WITH {TRIALS}, b AS (SELECT study, model AS method, min(value) AS best FROM trials GROUP BY 1, 2)
SELECT method, avg(best) AS mean, stddev_pop(best) AS std, count(*) AS n FROM b GROUP BY 1""", "mean std")
def method_compare(spark, d):
    return tr.method_compare(trials(spark, d), F.element_at("params", F.lit("model")))


@query("best_params", f"""WITH {TRIALS} SELECT study, trial_id, value, layers, model FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value, trial_id) AS k FROM trials) WHERE k = 1""", "value")
def best_params(spark, d):
    b = tr.best_params(trials(spark, d))
    return b.select("study", "trial_id", "value", F.element_at("params", F.lit("layers")).alias("layers"), F.element_at("params", F.lit("model")).alias("model"))


def runs(spark, d):
    t = trials(spark, d)
    return t.select(F.md5(F.col("trial_id").cast("string").cast("binary")).alias("run_id"), "status", "params",
                    F.create_map(F.lit("test_mae"), "value", F.lit("train_time"), "training_time").alias("metrics"))


@query("run_compare", f"WITH {TRIALS} SELECT md5(trial_id::VARCHAR)[1:8] AS run_id, status, value AS test_mae, training_time AS train_time, layers, model FROM trials", "test_mae train_time")
def run_compare(spark, d):
    return tr.run_compare(runs(spark, d), ["test_mae", "train_time"], ["layers", "model"])


@query("best_run", f"WITH {TRIALS} SELECT md5(trial_id::VARCHAR) AS run_id, value AS best_metric FROM trials ORDER BY value, run_id LIMIT 1", "best_metric")
def best_run(spark, d):
    return tr.best_run(runs(spark, d), "test_mae").select("run_id", "best_metric")


SPACE = {
    "kind": {"type": "categorical", "choices": ["small", "medium", "large"]}, "seq_len": {"type": "int", "low": 48, "high": 192},
    "patch_len": {"type": "int", "low": 4, "high": 32}, "stride": {"type": "int", "low": 2, "high": 24}, "d_model": {"type": "int", "low": 16, "high": 128},
    "n_heads": {"type": "int", "low": 1, "high": 8}, "dropout": {"type": "float", "low": 0.0, "high": 0.3}, "rate": {"type": "loguniform", "low": 1e-5, "high": 1e-2},
}


def _drawn_sql() -> str:
    def draw(name: str, s: dict) -> str:
        u = f"(('0x' || substr(md5('42|' || trial_id || '|{name}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
        if s["type"] == "categorical":
            return f"list_extract({s['choices']}, floor({u} * {len(s['choices'])})::INT + 1) AS {name}"
        if s["type"] == "int":
            return f"(floor({u} * {s['high'] - s['low'] + 1}) + {s['low']})::INT AS {name}"
        if s["type"] == "float":
            return f"{u} * ({s['high']}::DOUBLE - {s['low']}::DOUBLE) + {s['low']}::DOUBLE AS {name}"
        return f"exp({u} * (ln({s['high']}::DOUBLE) - ln({s['low']}::DOUBLE)) + ln({s['low']}::DOUBLE)) AS {name}"

    return "SELECT trial_id, " + ", ".join(draw(n, s) for n, s in SPACE.items()) + " FROM trials"


@query("random_params", f"""WITH {TRIALS}, r AS ({_drawn_sql()})
SELECT trial_id, kind, seq_len, patch_len, least(stride, patch_len) AS stride, greatest((d_model // n_heads) * n_heads, n_heads) AS d_model, n_heads, dropout, rate,
  least(seq_len // 2, 48)::INT AS label_len FROM r""", "dropout rate", digits=8)
def random_params(spark, d):
    """One seeded, consistent parameter set per trial."""
    return tr.random_params(trials(spark, d), "trial_id", SPACE)


@query("tick_quantiles", f"WITH {EVENT_TICKS} SELECT series_key, p AS prob, quantile_cont(price, p) AS quantile FROM event_ticks, (VALUES (0.05), (0.5), (0.95)) AS v(p) GROUP BY series_key, p".replace("quantile_cont(price, p)", "CASE p WHEN 0.05 THEN quantile_cont(price, 0.05) WHEN 0.5 THEN quantile_cont(price, 0.5) ELSE quantile_cont(price, 0.95) END"), "prob quantile")
def tick_quantiles(spark, d):
    """Exact quantiles of hot series from counted values."""
    return exact_quantiles(event_ticks(spark, d), ["series_key"], "price", [0.05, 0.5, 0.95])
