"""Queries: quality checks and profiles of damaged bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import cleaning as cl
from tideline.operators import quality as qu
from tideline.plans.inputs import BARS_D, DIRTY, ORDER_DAYS, bars_d, dirty_bars, order_days
from tideline.plans.registry import query

P, N = qu.PRICES, qu.NUMERIC
A = "PARTITION BY series_key ORDER BY seq"
EXT = ["avg_price", "n_small"]


def rows(spark, d):
    """Damaged bars with two external columns, one of them mostly missing."""
    days = order_days(spark, d).select("ts", "avg_price", F.when(F.col("n_orders") <= 3, F.col("n_orders").cast("double")).alias("n_small"))
    return dirty_bars(spark, d).join(days, "ts", "left")


def _m() -> str:
    pad = ", ".join(f"last_value({c} IGNORE NULLS) OVER ({A} ROWS UNBOUNDED PRECEDING) AS pad_{c}" for c in N)
    chg = ", ".join(f"abs(pad_{c} / nullif(lag(pad_{c}) OVER ({A}), 0) - 1) AS chg_{c}" for c in N)
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in P)
    aggs = []
    for c in P:
        aggs += [f"count(*) FILTER (chg_{c} > 0.5) AS jumps_{c}", f"count(*) FILTER ({c} <= 0) AS not_positive_{c}",
                 f"count(*) FILTER ({c} < q1_{c} - 3 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 3 * (q3_{c} - q1_{c})) AS outliers_{c}"]
    for c in [*N, *EXT]:
        aggs.append(f"count(*) FILTER ({c} IS NULL) AS missing_{c}")
    for c in N:
        aggs += [f"CASE WHEN min({c}) = max({c}) THEN 1 ELSE 0 END AS constant_{c}", f"skewness({c}) AS skew_{c}"]
    for c in EXT:
        aggs.append(f"abs(corr({c}, close)) AS corr_{c}")
    return f"""{DIRTY}, {ORDER_DAYS},
x AS (SELECT d.*, o.avg_price, CASE WHEN o.n_orders <= 3 THEN o.n_orders::DOUBLE END AS n_small FROM dirty d LEFT JOIN order_days o USING (ts)),
padded AS (SELECT *, lag(ts) OVER ({A}) AS before, {pad} FROM x),
changed AS (SELECT *, {chg}, epoch(ts) - epoch(before) AS gap FROM padded),
quart AS (SELECT series_key, {qs}, quantile_cont(volume, 0.5) AS med FROM x GROUP BY 1),
m AS (SELECT series_key, count(*) AS n, count(DISTINCT ts) AS nts, count(*) FILTER (volume < 0) AS negative_volume,
  count(*) FILTER (chg_volume > 10) AS spikes, count(*) FILTER (volume < med * 0.01) AS low_volume,
  stddev_samp(volume) / avg(volume) AS cv, max(gap) / 3600 AS max_gap, count(*) FILTER (gap < 0) AS unordered, count(DISTINCT gap) AS steps, min(gap) AS shortest,
  count(*) FILTER (high < greatest(open, close)) AS hv, count(*) FILTER (low > least(open, close)) AS lv, count(*) FILTER (high < low) AS hl,
  {', '.join(aggs)} FROM changed JOIN quart USING (series_key) GROUP BY 1)"""


M = _m()


def scored(issues: list[tuple[str, float]]) -> str:
    return "greatest(0.0, round(1 - (" + " + ".join(f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0 END" for c, p in issues) + "), 9))"


_CELLS, _MISS = f"(n * {1 + len(N) + len(EXT)})", "(" + " + ".join(f"missing_{c}" for c in [*N, *EXT]) + ")"
_ISSUES = {
    "consistency": [("n > nts", 0.3), ("negative_volume > 0", 0.2), *[(f"not_positive_{c} > 0", 0.1) for c in P]],
    "price": [x for c in P for x in ((f"jumps_{c} > 0", 0.2), (f"outliers_{c} > n * 0.01", 0.1))],
    "volume": [("spikes > 0", 0.3), ("low_volume > n * 0.05", 0.2), ("cv < 0.1", 0.2)],
    "temporal": [("max_gap > 24", 0.3), ("unordered > 0", 0.4), ("n > 2 AND NOT (steps = 1 AND shortest > 0)", 0.2)],
    "ohlc": [("hv > 0", 0.3), ("lv > 0", 0.3), ("hl > 0", 0.4)],
    "statistics": [x for c in N for x in ((f"constant_{c} = 1", 0.2), (f"constant_{c} = 0 AND abs(skew_{c}) > 5", 0.1))],
    "external": [*[(f"missing_{c} > n * 0.2", 0.1) for c in EXT], (" OR ".join(f"coalesce(corr_{c} < 0.01, false)" for c in EXT), 0.2)],
}
_NAMES = {"completeness": "Data Completeness", "consistency": "Data Consistency", "price": "Price Integrity", "volume": "Volume Integrity",
          "temporal": "Temporal Integrity", "ohlc": "OHLC Relationships", "statistics": "Statistical Properties", "external": "External Data Alignment"}
_WARN = {"statistics": 0.7, "external": 0.6}


def check_sql(name: str) -> str:
    if name == "completeness":
        share = f"({_MISS} / {_CELLS}::DOUBLE)"
        return (f"SELECT series_key, '{_NAMES[name]}' AS check_name, CASE WHEN {share} <= 0.05 THEN 1 ELSE 0 END AS passed, greatest(0.0, 1 - {share} / 0.05) AS score, "
                f"CASE WHEN {share} <= 0.05 THEN 'info' WHEN {share} < 0.1 THEN 'warning' ELSE 'error' END AS severity FROM m")
    s = scored(_ISSUES[name])
    ok = " AND ".join(f"NOT coalesce({c}, false)" for c, _ in _ISSUES[name])
    return (f"SELECT series_key, '{_NAMES[name]}' AS check_name, CASE WHEN {ok} THEN 1 ELSE 0 END AS passed, {s} AS score, "
            f"CASE WHEN {ok} THEN 'info' WHEN {s} > {_WARN.get(name, 0.5)} THEN 'warning' ELSE 'error' END AS severity FROM m")


for _name in _NAMES:

    @query(f"dq_{_name}", f"WITH {M} {check_sql(_name)}", "score")
    def dq(spark, d, name=_name):
        m = qu.measure(rows(spark, d), external=EXT)
        r = qu.quality_checks(m, [name], external=EXT)
        return r.select("series_key", "check_name", F.col("passed").cast("int").alias("passed"), "score", "severity")


_ALL = " UNION ALL ".join(f"SELECT * FROM ({check_sql(n)})" for n in _NAMES)


@query("dq_report", f"WITH {M} {_ALL}", "score")
def dq_report(spark, d):
    """All checks of all series from one set of measures."""
    r = qu.quality_checks(qu.measure(rows(spark, d), external=EXT), external=EXT)
    return r.select("series_key", "check_name", F.col("passed").cast("int").alias("passed"), "score", "severity")


@query("dq_overall", f"""WITH {M}, r AS ({_ALL}) SELECT series_key, sum(score * CASE check_name WHEN 'Data Completeness' THEN 0.3 WHEN 'Data Consistency' THEN 0.25
  WHEN 'Price Integrity' THEN 0.25 WHEN 'Temporal Integrity' THEN 0.2 ELSE 0.1 END) / 1.0 AS overall_score FROM r GROUP BY 1""", "overall_score")
def dq_overall(spark, d):
    return qu.overall_score(qu.quality_checks(qu.measure(rows(spark, d), external=EXT), external=EXT))


_IND = """SELECT series_key, count(*) AS n_rows, count(*) - count(DISTINCT (ts, open, high, low, close, volume)) AS duplicate_rows,
  sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT)::BIGINT AS missing_cells,
  (count(*) FILTER (volume < 0) + count(*) FILTER (open <= 0) + count(*) FILTER (high <= 0) + count(*) FILTER (low <= 0) + count(*) FILTER (close <= 0))::BIGINT AS invalid_cells
  FROM dirty GROUP BY 1"""
_IND2 = f"""SELECT *, (completeness + consistency + validity) / 3 AS overall_quality FROM (
  SELECT *, 1 - missing_cells / (n_rows * 6.0::DOUBLE) AS completeness, 1 - duplicate_rows / n_rows::DOUBLE AS consistency,
    1 - invalid_cells / (n_rows * 5.0::DOUBLE) AS validity FROM ({_IND}))"""
_ADVICE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in qu.ADVICE.items())


@query("dq_recommend", f"""WITH {M}, r AS ({_ALL}) SELECT series_key, advice FROM (SELECT series_key, CASE check_name {_ADVICE} END AS advice FROM r WHERE passed = 0)
WHERE advice IS NOT NULL UNION ALL SELECT series_key, 'enhance the data set as a whole' FROM ({_IND2}) WHERE overall_quality < 0.8""")
def dq_recommend(spark, d):
    r = qu.quality_checks(qu.measure(rows(spark, d), external=EXT), external=EXT)
    return qu.recommendations(r, qu.quality_indicators(dirty_bars(spark, d)), has_external=True)


@query("quality_indicators", f"WITH {DIRTY} SELECT series_key, completeness, consistency, validity, overall_quality FROM ({_IND2})",
       "completeness consistency validity overall_quality")
def quality_indicators(spark, d):
    return qu.quality_indicators(dirty_bars(spark, d)).select("series_key", "completeness", "consistency", "validity", "overall_quality")


@query("table_profile", f"WITH {DIRTY} SELECT series_key, n_rows, missing_cells, duplicate_rows FROM ({_IND})")
def table_profile(spark, d):
    return qu.quality_indicators(dirty_bars(spark, d)).select("series_key", "n_rows", "missing_cells", "duplicate_rows")


_G2 = "CASE WHEN count(x) > 3 THEN kurtosis(x) END"


@query("column_profile", f"""WITH {DIRTY}, long AS ({' UNION ALL '.join(f"SELECT series_key, '{c}' AS column, {c} AS x FROM dirty" for c in N)}),
q AS (SELECT series_key, "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM long GROUP BY 1, 2)
SELECT series_key, "column", count(*) AS n_rows, count(*) - count(x) AS missing, count(DISTINCT x) AS n_distinct, avg(x) AS mean, stddev_samp(x) AS std,
  min(x) AS min, max(x) AS max, max(q2) AS median, skewness(x) AS skew, {_G2} AS kurtosis,
  count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) FILTER (x = 0) AS zeros
FROM long JOIN q USING (series_key, "column") GROUP BY 1, 2""", "mean std min max median skew kurtosis", digits=4)
def column_profile(spark, d):
    return qu.column_profile(dirty_bars(spark, d))


@query("ts_profile", f"""WITH {BARS_D}, s AS (SELECT series_key, ts, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_key ORDER BY ts)))::BIGINT AS step FROM bars),
u AS (SELECT series_key, step AS usual FROM (SELECT series_key, step, row_number() OVER (PARTITION BY series_key ORDER BY count(*) DESC, step) AS k
  FROM s WHERE step IS NOT NULL GROUP BY 1, 2) WHERE k = 1)
SELECT series_key, epoch(min(ts))::BIGINT AS start, epoch(max(ts))::BIGINT AS end, count(*) AS periods, max(usual) AS usual_step, max(step) / 3600.0 AS max_gap_hours,
  count(*) FILTER (step > 2 * usual) AS wide_gaps, ((epoch(max(ts)) - epoch(min(ts))) // 86400)::BIGINT AS days FROM s JOIN u USING (series_key) GROUP BY 1""", "max_gap_hours")
def ts_profile(spark, d):
    return qu.ts_profile(bars_d(spark, d))


@query("drift", f"""WITH {BARS_D}, long AS ({' UNION ALL '.join(f"SELECT series_key, '{c}' AS column, {c} AS x, {c} * {k} AS y FROM bars" for c, k in zip(N, (1, 1, 1, 1.2, 2)))}),
s AS (SELECT series_key, "column", avg(x) AS baseline_mean, stddev_samp(x) AS baseline_std, avg(y) AS current_mean, stddev_samp(y) AS current_std FROM long GROUP BY 1, 2),
t AS (SELECT *, (abs(baseline_mean - current_mean) / abs(baseline_mean) + abs(baseline_std - current_std) / abs(baseline_std)) / 2 AS drift_score FROM s)
SELECT *, CASE WHEN drift_score > 0.1 THEN 1 ELSE 0 END AS significant FROM t""",
       "baseline_mean baseline_std current_mean current_std drift_score", digits=4)
def drift(spark, d):
    b = bars_d(spark, d)
    return qu.drift(b, b.withColumns({"close": F.col("close") * 1.2, "volume": F.col("volume") * 2}))


@query("drift_summary", f"""WITH {BARS_D}, long AS ({' UNION ALL '.join(f"SELECT series_key, '{c}' AS column, {c} AS x, {c} * {k} AS y FROM bars" for c, k in zip(N, (1, 1, 1, 1.2, 2)))}),
s AS (SELECT series_key, "column", avg(x) AS bm, stddev_samp(x) AS bs, avg(y) AS cm, stddev_samp(y) AS cs FROM long GROUP BY 1, 2),
t AS (SELECT series_key, "column", (abs(bm - cm) / abs(bm) + abs(bs - cs) / abs(bs)) / 2 AS score FROM s)
SELECT series_key, avg(score) AS overall_drift, coalesce(string_agg("column", ', ' ORDER BY "column") FILTER (score > 0.1), '') AS drifted_columns FROM t GROUP BY 1""", "overall_drift")
def drift_summary(spark, d):
    b = bars_d(spark, d)
    return qu.drift_summary(qu.drift(b, b.withColumns({"close": F.col("close") * 1.2, "volume": F.col("volume") * 2})))


@query("quality_improvement", f"""WITH {DIRTY}, u AS (SELECT DISTINCT series_key, ts FROM dirty),
a AS (SELECT series_key, sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT) AS miss, count(*) * 5 AS cells FROM dirty GROUP BY 1)
SELECT series_key, CASE WHEN miss > 0 THEN 1.0 ELSE 0.0 END AS missing_data_reduction, miss / cells AS data_completeness_improvement, 0.6 AS additional_features_ratio FROM a""",
       "missing_data_reduction data_completeness_improvement additional_features_ratio")
def quality_improvement(spark, d):
    b = dirty_bars(spark, d)
    return qu.quality_improvement(b, cl.clean_bars(b), N, 3)


