"""Queries: splits, scaling, windows, folds, time encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import joins as jn
from tideline.operators import splits as sp
from tideline.plans.inputs import BARS_D, EVENT_TICKS, bars_d, epoch, event_ticks, table
from tideline.plans.registry import query

W = "PARTITION BY series_key ORDER BY ts"
TS = "epoch(ts)::BIGINT AS ts"
POS = BARS_D + f""", p AS (SELECT series_key, ts, close, volume, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_key) AS n FROM bars)"""


def pos(spark, d):
    return sp.positioned(bars_d(spark, d).select("series_key", "ts", "close", "volume"))


def _roles(borders: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT series_key, {TS}, '{r}' AS role FROM p WHERE rn >= {a} AND rn < {z}" for r, (a, z) in borders.items())


def _picked(df):
    return epoch(df).select("series_key", "ts", "role")


@query("split_ratio", f"WITH {POS} " + _roles({"train": ("0", "floor(n * 0.7)"), "val": ("floor(n * 0.7) - 24", "n - floor(n * 0.2)"), "test": ("n - floor(n * 0.2) - 24", "n")}))
def split_ratio(spark, d):
    return _picked(sp.split_ratio(pos(spark, d), 24))


@query("split_ratio_percent", f"WITH {POS} " + _roles({"train": ("0", "floor((floor(n * 0.7) - 24) * 10 / 100) + 24"), "val": ("floor(n * 0.7) - 24", "n - floor(n * 0.2)"), "test": ("n - floor(n * 0.2) - 24", "n")}))
def split_ratio_percent(spark, d):
    """Few-shot variant: ten percent of the training rows."""
    return _picked(sp.split_ratio(pos(spark, d), 24, percent=10))


@query("split_fixed_months", f"WITH {POS} " + _roles({"train": ("0", "360"), "val": ("336", "480"), "test": ("456", "600")}))
def split_fixed_months(spark, d):
    return _picked(sp.split_months(pos(spark, d), 24, rows_per_day=1))


@query("split_tail", f"WITH {POS} " + _roles({"train": ("0", "400"), "test": ("n - 10 - 24", "n")}))
def split_tail(spark, d):
    return _picked(sp.split_tail(pos(spark, d), 400, 10, 24))


def _scaled(kind: str, inverse: bool = False):
    def run(spark, d):
        p = pos(spark, d)
        s = sp.fit_scaler(p.where(F.col("rn") < F.floor(F.col("n") * 0.7)), ["close", "volume"], kind)
        out = sp.scale(p, s, ["close", "volume"])
        out = sp.scale(out, s, ["close", "volume"], inverse=True) if inverse else out
        return epoch(out).select("series_key", "ts", "close", "volume")

    return run


_STD = "avg(close) AS cc, stddev_pop(close) AS cs, avg(volume) AS vc, stddev_pop(volume) AS vs"
_ROB = ("quantile_cont(close, 0.5) AS cc, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS cs, "
        "quantile_cont(volume, 0.5) AS vc, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS vs")
for _name, _kind, _fit in (("standard_scale", "standard", _STD), ("robust_scale", "robust", _ROB)):
    query(_name, f"""WITH {POS}, s AS (SELECT series_key, {_fit} FROM p WHERE rn < floor(n * 0.7) GROUP BY 1)
SELECT series_key, {TS}, (close - cc) / CASE WHEN cs = 0 THEN 1 ELSE cs END AS close, (volume - vc) / CASE WHEN vs = 0 THEN 1 ELSE vs END AS volume
FROM p JOIN s USING (series_key)""", "close volume")(_scaled(_kind))
query("inverse_scale", f"WITH {POS} SELECT series_key, {TS}, close, volume FROM p", "close volume")(_scaled("standard", True))


@query("sliding_windows", f"""WITH {POS}, l AS (SELECT series_key, ts, rn, n, 'close' AS feature, close AS x FROM p UNION ALL SELECT series_key, ts, rn, n, 'volume', volume FROM p),
w AS (SELECT series_key, feature, ts, rn, n, x AS x_first,
  last_value(x) OVER (PARTITION BY series_key, feature ORDER BY rn ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS x_last,
  sum(x) OVER (PARTITION BY series_key, feature ORDER BY rn ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS x_sum,
  first_value(x) OVER (PARTITION BY series_key, feature ORDER BY rn ROWS BETWEEN 12 FOLLOWING AND 19 FOLLOWING) AS y_first,
  last_value(x) OVER (PARTITION BY series_key, feature ORDER BY rn ROWS BETWEEN 12 FOLLOWING AND 19 FOLLOWING) AS y_last,
  sum(x) OVER (PARTITION BY series_key, feature ORDER BY rn ROWS BETWEEN 12 FOLLOWING AND 19 FOLLOWING) AS y_sum FROM l)
SELECT series_key, feature, {TS}, x_first, x_last, x_sum, y_first, y_last, y_sum FROM w WHERE rn + 20 <= n""", "x_first x_last x_sum y_first y_last y_sum", digits=4)
def sliding_windows(spark, d):
    """Channel-independent samples of 16 rows in, 4 shared and 4 new rows out; ends and sums shown."""
    s = sp.sliding_windows(bars_d(spark, d).select("series_key", "ts", "close", "volume"), ["close", "volume"], 16, 4, 4)
    ends = {f"{a}_{n}": F.element_at(f"seq_{a}", i) for a in "xy" for n, i in (("first", 1), ("last", -1))}
    out = s.withColumns(ends | {f"{a}_sum": sp.array_sum(F.col(f"seq_{a}")) for a in "xy"})
    return epoch(out).select("series_key", "feature", "ts", "x_first", "x_last", "x_sum", "y_first", "y_last", "y_sum")


# --- panel of arrays: whole embeddings, with some first values again so that lengths differ -----------------------------------

def panel(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("series_id"), F.col("label").alias("grp"),
        F.concat("embedding", F.slice("embedding", F.lit(1), (F.col("vec_id") % 25).cast("int"))).cast("array<double>").alias("vals"),
    )


PANEL = """panel AS (SELECT vec_id AS series_id, label AS grp, (embedding || embedding[1:vec_id % 25])::DOUBLE[] AS vals FROM embeddings)"""


@query("scan_panel", f"WITH {PANEL} SELECT series_id, grp, unnest(vals) AS value, generate_subscripts(vals, 1)::INT AS t FROM panel WHERE grp IN (0, 1, 2)", "value")
def scan_panel(spark, d):
    """Wide ragged series of chosen groups in long form."""
    from tideline.sources.readers import panel_to_long

    return panel_to_long(panel(spark, d), "vals", ["series_id", "grp"]).where(F.col("grp").isin(0, 1, 2))


@query("instance_norm", f"""WITH {PANEL}, s AS (SELECT series_id, vals, list_avg(vals) AS m, list_var_pop(vals) AS v FROM panel)
SELECT series_id, m AS centre, sqrt(v + 1e-5) AS spread, (vals[1] - m) / sqrt(v + 1e-5) AS first, (vals[-1] - m) / sqrt(v + 1e-5) AS last, vals[-1] AS restored FROM s""",
       "centre spread first last restored")
def instance_norm(spark, d):
    n = sp.instance_norm(panel(spark, d), "vals")
    back = sp.instance_denorm(n.select("series_id", "vals", "centre", "spread").withColumn("normed", F.col("vals")), "vals")
    return back.select("series_id", "centre", "spread", F.element_at("normed", 1).alias("first"), F.element_at("normed", -1).alias("last"), F.element_at("vals", -1).alias("restored"))


@query("instance_norm_last", f"""WITH {PANEL}, s AS (SELECT series_id, vals, list_var_pop(vals) AS v FROM panel)
SELECT series_id, (vals[1] - vals[-1]) / sqrt(v + 1e-5) AS first, (vals[-1] - vals[-1]) / sqrt(v + 1e-5) AS last FROM s""", "first last")
def instance_norm_last(spark, d):
    n = sp.instance_norm(panel(spark, d), "vals", subtract_last=True)
    return n.select("series_id", F.element_at("vals", 1).alias("first"), F.element_at("vals", -1).alias("last"))


@query("patches", f"""WITH {PANEL}, p AS (SELECT series_id, list_concat(vals, [vals[-1], vals[-1], vals[-1], vals[-1], vals[-1], vals[-1], vals[-1], vals[-1]]) AS v, ((len(vals) + 8 - 16) // 8 + 1) AS k FROM panel),
q AS (SELECT series_id, v, unnest(range(k)) AS patch FROM p)
SELECT series_id, patch::INT AS patch, v[patch * 8 + 1] AS first, v[patch * 8 + 16] AS last, list_sum(v[patch * 8 + 1:patch * 8 + 16]) AS total FROM q""", "first last total")
def patches(spark, d):
    q = panel(spark, d).select("series_id", F.posexplode(sp.patches(F.col("vals"), 16, 8)).alias("patch", "v"))
    return q.select("series_id", "patch", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"), sp.array_sum(F.col("v")).alias("total"))


@query("last_insample_window", f"""WITH {PANEL}, p AS (SELECT series_id, vals, greatest(80 - len(vals), 0) AS pad, vals[-least(80, len(vals)):] AS w FROM panel)
SELECT series_id, 80 AS width, (80 - pad)::DOUBLE AS mask_sum, CASE WHEN pad > 0 THEN 0.0 ELSE w[1] END AS first, w[-1] AS last, list_sum(w) AS total FROM p""",
       "mask_sum first last total")
def last_insample_window(spark, d):
    w = sp.last_insample_window(panel(spark, d), "vals", 80)
    return w.select("series_id", F.size("insample").alias("width"), sp.array_sum(F.col("insample_mask")).alias("mask_sum"),
                    F.element_at("insample", 1).alias("first"), F.element_at("insample", -1).alias("last"), sp.array_sum(F.col("insample")).alias("total"))


@query("m4_window_sample", f"""WITH {PANEL}, c AS (SELECT series_id, len(vals) AS n, greatest(1, len(vals) - 30) AS low,
  ('0x' || substr(md5('7|' || series_id), 1, 13))::BIGINT AS h FROM panel), k AS (SELECT *, (low + h % greatest(n - low, 1))::INT AS cut FROM c)
SELECT series_id, cut, 20 AS n_in, 15 AS n_out, least(cut, 20)::DOUBLE AS in_mask, (least(n, cut + 10) - greatest(0, cut - 5))::DOUBLE AS out_mask FROM k""", "in_mask out_mask")
def m4_window_sample(spark, d):
    w = sp.panel_window_sample(panel(spark, d), "series_id", "vals", 20, 5, 10, 30, seed=7)
    return w.select("series_id", "cut", F.size("insample").alias("n_in"), F.size("outsample").alias("n_out"),
                    sp.array_sum(F.col("insample_mask")).alias("in_mask"), sp.array_sum(F.col("outsample_mask")).alias("out_mask"))


def _trend(k: int) -> str:
    h = (k - 1) // 2
    return (f"(sum(close) OVER ({W} ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) + greatest(0, {h} - rn) * first_value(close) OVER ({W}) "
            f"+ greatest(0, {h} - (n - 1 - rn)) * last_value(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {k}")


@query("series_decompose", f"WITH {POS}, t AS (SELECT *, ({_trend(25)} + {_trend(7)}) / 2 AS trend FROM p) SELECT series_key, {TS}, trend, close - trend AS seasonal FROM t", "trend seasonal", digits=4)
def series_decompose(spark, d):
    return epoch(sp.series_decompose(bars_d(spark, d), "close", (25, 7))).select("series_key", "ts", "trend", "seasonal")


# --- folds -------------------------------------------------------------------------------

_LEN = BARS_D + ", l AS (SELECT series_key, count(*) AS n FROM bars GROUP BY 1)"


def _fold_sql(splits: int, roles: dict[str, tuple[str, str]], keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT series_key, fold::INT AS fold, '{r}' AS role, ({a})::BIGINT AS lo, ({z})::BIGINT AS hi FROM l, range({splits}) AS f(fold) WHERE {keep} AND ({z}) > ({a})"
        for r, (a, z) in roles.items())


_EXP = _fold_sql(6, {"train": ("0", "200 + fold * 60 - 50"), "val": ("200 + fold * 60 - 50", "200 + fold * 60"), "test": ("200 + fold * 60 + 5", "200 + fold * 60 + 65")}, "200 + fold * 60 + 65 <= n")
_SIZE = "least(50, (fold + 1) * 100 // 4)"
_BLK = _fold_sql(6, {"train": ("0", f"(fold + 1) * 100 - {_SIZE}"), "val": (f"(fold + 1) * 100 - {_SIZE}", "(fold + 1) * 100"), "test": ("(fold + 1) * 100", "least((fold + 1) * 100 + 100, n)")},
                 "fold < CASE WHEN n // 100 < 7 THEN greatest(1, n // 100 - 1) ELSE 6 END AND least((fold + 1) * 100 + 100, n) > (fold + 1) * 100")
_PE = "200 + fold * 60 - 10"
_PSZ = f"least(50, ({_PE}) // 4)"
_PRG = _fold_sql(6, {"train": ("0", f"{_PE} - {_PSZ}"), "val": (f"{_PE} - {_PSZ}", _PE), "test": ("200 + fold * 60", "260 + fold * 60")}, "200 + fold * 60 + 60 + 12 <= n")
_WLK = _fold_sql(50, {"train": ("fold * 24", "fold * 24 + 200"), "val": ("fold * 24 + 200", "fold * 24 + 260")}, "fold * 24 + 260 <= n")


def expanding(spark, d):
    return sp.expanding_folds(sp.series_lengths(bars_d(spark, d)), 200, 50, 5, 60, 60, 6)


query("expanding_folds", f"WITH {_LEN} {_EXP}")(expanding)


@query("blocked_folds", f"WITH {_LEN} {_BLK}")
def blocked_folds(spark, d):
    return sp.blocked_folds(sp.series_lengths(bars_d(spark, d)), 100, 50, 6)


@query("purged_folds", f"WITH {_LEN} {_PRG}")
def purged_folds(spark, d):
    return sp.purged_folds(sp.series_lengths(bars_d(spark, d)), 200, 50, 60, 60, 6, 10, 12)


@query("walk_forward_windows", f"WITH {_LEN} {_WLK}")
def walk_forward_windows(spark, d):
    return sp.walk_forward_windows(sp.series_lengths(bars_d(spark, d)), 200, 60, 24)


@query("leakage_check", f"WITH {_LEN}, f AS ({_EXP}) SELECT series_key, fold, 0 AS overlaps, CASE WHEN max(hi) FILTER (role = 'train') - 1 >= min(lo) FILTER (role = 'test') - 60 THEN 1 ELSE 0 END AS within_gap FROM f GROUP BY 1, 2")
def leakage_check(spark, d):
    return sp.leakage_check(expanding(spark, d), gap=60)


@query("fold_overlap", f"WITH {_LEN}, f AS ({_BLK}) SELECT a.series_key, a.fold, max(CASE WHEN a.lo < b.hi AND b.lo < a.hi THEN 1 ELSE 0 END) AS overlaps FROM f a JOIN f b ON a.series_key = b.series_key AND a.fold = b.fold AND b.role = 'test' AND a.role <> 'test' GROUP BY 1, 2")
def fold_overlap(spark, d):
    return sp.leakage_check(blocked_folds(spark, d)).drop("within_gap")


@query("fold_range_join", f"WITH {POS}, l AS (SELECT DISTINCT series_key, n FROM p), f AS ({_EXP}) SELECT p.series_key, fold, role, count(*) AS n_rows, avg(close) AS mean_close FROM p JOIN f ON p.series_key = f.series_key AND rn >= lo AND rn < hi GROUP BY 1, 2, 3",
       "mean_close", digits=4)
def fold_range_join(spark, d):
    rows = jn.rows_in_ranges(pos(spark, d), expanding(spark, d), "rn")
    return rows.groupBy("series_key", "fold", "role").agg(F.count("*").alias("n_rows"), F.avg("close").alias("mean_close"))


# --- time --------------------------------------------------------------------------------

@query("time_parts", f"WITH {EVENT_TICKS} SELECT seq, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour, (minute(ts) // 15)::INT AS quarter_hour FROM event_ticks")
def time_parts(spark, d):
    return sp.time_parts(event_ticks(spark, d)).select("seq", "month", "day", "weekday", "hour", "quarter_hour")


_TF = {
    "second_of_minute": "floor(second(ts)) / 59.0 - 0.5", "minute_of_hour": "minute(ts) / 59.0 - 0.5", "hour_of_day": "hour(ts) / 23.0 - 0.5",
    "day_of_week": "(isodow(ts) - 1) / 6.0 - 0.5", "day_of_month": "(day(ts) - 1) / 30.0 - 0.5", "day_of_year": "(dayofyear(ts) - 1) / 365.0 - 0.5",
    "month_of_year": "(month(ts) - 1) / 11.0 - 0.5", "week_of_year": "(weekofyear(ts) - 1) / 52.0 - 0.5",
}
for _f in ("S", "T", "H"):
    _cols = sp.BY_FREQUENCY[_f]

    @query(f"time_features_{_f.lower()}", f"WITH {EVENT_TICKS} SELECT seq, {', '.join(f'{_TF[c]} AS {c}' for c in _cols)} FROM event_ticks", " ".join(_cols))
    def time_features(spark, d, f=_f):
        return sp.time_features(event_ticks(spark, d), f).select("seq", *sp.BY_FREQUENCY[f])


for _f in ("D", "B", "W", "M", "Q"):
    _cols = sp.BY_FREQUENCY[_f]

    @query(f"time_features_{_f.lower()}", f"WITH {BARS_D} SELECT series_key, {TS}, {', '.join(f'{_TF[c]} AS {c}' for c in _cols)} FROM bars", " ".join(_cols))
    def time_features_slow(spark, d, f=_f):
        return epoch(sp.time_features(bars_d(spark, d), f)).select("series_key", "ts", *sp.BY_FREQUENCY[f])


@query("future_stamps", f"WITH {BARS_D}, m AS (SELECT series_key, max(ts) AS ts FROM bars GROUP BY 1) SELECT series_key, step::INT AS step, (epoch(ts) + step * 86400)::BIGINT AS ts FROM m, range(1, 11) AS r(step)")
def future_stamps(spark, d):
    last = bars_d(spark, d).groupBy("series_key").agg(F.max("ts").alias("ts"))
    return epoch(sp.future_stamps(last, 86400, 10)).select("series_key", "step", "ts")
