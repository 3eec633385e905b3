"""Queries: projection, filters, cleaning, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import cleaning as cl
from tideline.operators.isolation import isolation_flag
from tideline.operators.ordered import Slices, ordinal
from tideline.plans.inputs import (
    TICKS, BARS_D, DIRTY, EVENT_TICKS, ORDER_DAYS, bars_d, dirty_bars, epoch, event_ticks, order_days, table,
)
from tideline.plans.registry import query

P = ["open", "high", "low", "close"]
PV = [*P, "volume"]
PVS = " ".join(PV)
COLS = ", ".join(PV)
W = "PARTITION BY series_key ORDER BY ts"
TS = "epoch(ts)::BIGINT AS ts"


@query("select_mode", f"WITH {BARS_D} SELECT series_key, {COLS} FROM bars", PVS)
def select_mode(spark, d):
    return cl.select_mode(bars_d(spark, d), "M")


@query("select_mode_single", f"WITH {BARS_D} SELECT series_key, close FROM bars", "close")
def select_mode_single(spark, d):
    return cl.select_mode(bars_d(spark, d), "S")


_SEL = (f"WITH {BARS_D} SELECT series_key, {TS}, {COLS}, lag(close, 1) OVER ({W}) AS close_lag_1, "
        f"lag(close, 3) OVER ({W}) AS close_lag_3 FROM bars")


@query("filter_selected", _SEL, PVS + " close_lag_1 close_lag_3")
def filter_selected(spark, d):
    from tideline.operators.indicators import add_features, lag_features

    f = add_features(bars_d(spark, d), [lag_features()])
    return epoch(cl.filter_selected(f, ["close_lag_1", "close_lag_3", "not_there"]))


@query("selector_transform", _SEL, PVS + " close_lag_1 close_lag_3")
def selector_transform(spark, d):
    from tideline.operators.indicators import add_features, lag_features
    from tideline.operators.selection import selector_transform as transform

    return epoch(transform(add_features(bars_d(spark, d), [lag_features()]), ["close_lag_1", "close_lag_3"]))


@query("normalise_columns", f"""
WITH {EVENT_TICKS} SELECT floor(epoch(ts))::BIGINT AS ts, series_key, price FROM event_ticks""", "price")
def normalise_columns(spark, d):
    raw = event_ticks(spark, d).select(
        F.col("series_key").alias(" Series_Key"), F.unix_timestamp("ts").alias("Trade_Time "), F.col("price").alias("PRICE")
    )
    return epoch(cl.normalise_columns(raw))


@query("clean_nonnumeric", """
SELECT l_orderkey AS id, l_linenumber AS line, price, qty FROM (
  SELECT l_orderkey, l_linenumber,
    TRY_CAST(CASE WHEN l_partkey % 17 = 0 THEN 'n/a' ELSE CAST(l_extendedprice AS VARCHAR) END AS DOUBLE) AS price,
    TRY_CAST(CASE WHEN l_partkey % 19 = 0 THEN '' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS qty
  FROM lineitem) WHERE price IS NOT NULL AND qty IS NOT NULL""", "price qty")
def clean_nonnumeric(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_partkey") % 17 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(F.col("l_partkey") % 19 == 0, "").otherwise(F.col("l_quantity").cast("string")).alias("qty"),
    )
    return cl.clean_nonnumeric(li, ["price", "qty"])


@query("dedup_rows", f"WITH {DIRTY} SELECT DISTINCT series_key, {TS}, {COLS} FROM dirty", PVS)
def dedup_rows(spark, d):
    return epoch(cl.dedup_rows(dirty_bars(spark, d).drop("seq")))


@query("dedup_timestamp", f"""WITH {DIRTY} SELECT series_key, {TS}, {COLS}, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY series_key, ts ORDER BY seq) AS k FROM dirty) WHERE k = 1""", PVS)
def dedup_timestamp(spark, d):
    return epoch(cl.dedup_timestamp(dirty_bars(spark, d), PV))


def _each(expr: str, cols=PV) -> str:
    return ", ".join(expr.format(c=c) + f" AS {c}" for c in cols)


SEQW = "PARTITION BY series_key ORDER BY ts, seq"
_FF = "last_value({c} IGNORE NULLS) OVER (" + SEQW + " ROWS UNBOUNDED PRECEDING)"
_BF = "first_value({c} IGNORE NULLS) OVER (" + SEQW + " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("ffill", f"WITH {DIRTY} SELECT series_key, {TS}, seq, {_each(_FF)} FROM dirty", PVS)
def ffill(spark, d):
    return epoch(cl.ffill(dirty_bars(spark, d), PV, order=("ts", "seq")))


@query("bfill", f"WITH {DIRTY} SELECT series_key, {TS}, seq, {_each(_BF)} FROM dirty", PVS)
def bfill(spark, d):
    return epoch(cl.bfill(dirty_bars(spark, d), PV, order=("ts", "seq")))


@query("interpolate_linear", f"""WITH {DIRTY}, p AS (
  SELECT *, row_number() OVER ({SEQW}) AS i FROM dirty),
q AS (SELECT series_key, ts, seq, volume, i,
  last_value(volume IGNORE NULLS) OVER ({SEQW} ROWS UNBOUNDED PRECEDING) AS x0,
  last_value(CASE WHEN volume IS NOT NULL THEN i END IGNORE NULLS) OVER ({SEQW} ROWS UNBOUNDED PRECEDING) AS i0,
  first_value(volume IGNORE NULLS) OVER ({SEQW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1,
  first_value(CASE WHEN volume IS NOT NULL THEN i END IGNORE NULLS) OVER ({SEQW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1
  FROM p)
SELECT series_key, {TS}, seq, CASE WHEN volume IS NOT NULL THEN volume WHEN x0 IS NULL THEN NULL
  WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (i - i0) / (i1 - i0) END AS volume FROM q""", "volume")
def interpolate_linear(spark, d):
    return epoch(cl.interpolate_linear(dirty_bars(spark, d).select("series_key", "ts", "seq", "volume"), ["volume"], order=("ts", "seq")))


@query("fill_median", f"""WITH {DIRTY}, m AS (SELECT series_key, quantile_cont(volume, 0.5) AS mv FROM dirty GROUP BY 1)
SELECT series_key, {TS}, seq, coalesce(volume, mv) AS volume FROM dirty JOIN m USING (series_key)""", "volume")
def fill_median(spark, d):
    return epoch(cl.fill_median(dirty_bars(spark, d).select("series_key", "ts", "seq", "volume"), ["volume"]))


@query("fill_mode", """WITH t AS (
  SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders),
c AS (SELECT o_orderpriority, status, count(*) AS n FROM t WHERE status IS NOT NULL GROUP BY 1, 2),
m AS (SELECT o_orderpriority, status AS mode FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, status) AS k FROM c) WHERE k = 1)
SELECT o_orderkey, o_orderpriority, coalesce(status, mode, 'unknown') AS status FROM t LEFT JOIN m USING (o_orderpriority)""")
def fill_mode(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")).alias("status")
    )
    return cl.fill_mode(o, "status", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "status")


@query("impute_chain", f"""WITH {DIRTY}, f AS (SELECT series_key, ts, seq, {_each(_FF, P)}, volume FROM dirty),
b AS (SELECT series_key, ts, seq, {_each(_BF)} FROM f),
l AS (SELECT series_key, ts, seq, {_each(_FF)} FROM b)
SELECT series_key, {TS}, seq, {COLS} FROM l""", PVS)
def impute_chain(spark, d):
    return epoch(cl.impute_chain(dirty_bars(spark, d), order=("ts", "seq")))


# every row without a volume against every row of its series that has one
KNN = """n AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts, seq) AS i FROM dirty),
blank AS (SELECT * FROM n WHERE volume IS NULL), donor AS (SELECT * FROM n WHERE volume IS NOT NULL),
gaps AS (SELECT a.series_key, a.i, b.i AS j, b.volume AS y, a.close - b.close AS c, a.open - b.open AS o FROM blank a JOIN donor b USING (series_key)),
ranked AS (SELECT series_key, i, y, row_number() OVER (PARTITION BY series_key, i
    ORDER BY sqrt((coalesce(c * c, 0) + coalesce(o * o, 0)) * 2.0::DOUBLE / ((c IS NOT NULL)::INT + (o IS NOT NULL)::INT)), j) AS k FROM gaps WHERE c IS NOT NULL OR o IS NOT NULL),
near AS (SELECT series_key, i, avg(y) AS guess FROM ranked WHERE k <= 5 GROUP BY 1, 2)"""


@query("impute_knn", f"""WITH {DIRTY}, {KNN}
SELECT series_key, {TS}, seq, coalesce(volume, guess) AS volume FROM n LEFT JOIN near USING (series_key, i)""", "volume")
def impute_knn(spark, d):
    out = cl.impute_knn(dirty_bars(spark, d), "volume", ["close", "open"], order=("ts", "seq"))
    return epoch(out).select("series_key", "ts", "seq", "volume")


def _cap(mode: str) -> str:
    low = "1.5" if mode == "reference" else "0.5"
    prev = "lag({c}) OVER (" + W + ")"
    return ("CASE WHEN {c} / " + prev + " - 1 > 0.5 THEN " + prev + " * 1.5 WHEN {c} / " + prev + " - 1 < -0.5 THEN "
            + prev + f" * {low} ELSE {{c}} END")


for _mode, _name in (("by_sign", "cap_jump"), ("reference", "cap_jump_upward")):

    @query(_name, f"WITH {BARS_D} SELECT series_key, {TS}, {_each(_cap(_mode), P)}, volume FROM bars", PVS)
    def cap_jump(spark, d, mode=_mode):
        return epoch(cl.cap_jump(bars_d(spark, d), mode=mode))


@query("clip_volume", f"WITH {DIRTY} SELECT series_key, seq, CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume FROM dirty", "volume")
def clip_volume(spark, d):
    return cl.clip_volume(dirty_bars(spark, d)).select("series_key", "seq", "volume")


@query("enforce_ohlc", f"""WITH {DIRTY} SELECT series_key, seq, greatest(high, open, close) AS high, least(low, open, close) AS low FROM dirty""", "high low")
def enforce_ohlc(spark, d):
    return cl.enforce_ohlc(dirty_bars(spark, d)).select("series_key", "seq", "high", "low")


_FT = "coalesce(last_value({c} IGNORE NULLS) OVER (" + W + " ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (" + W + " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("clean_bars", f"""WITH {DIRTY}, u AS (SELECT DISTINCT series_key, ts, {COLS} FROM dirty),
f AS (SELECT series_key, ts, {_each(_FT)} FROM u),
k AS (SELECT series_key, ts, {_each(_cap("by_sign"), P)}, greatest(volume, 0) AS volume FROM f)
SELECT series_key, {TS}, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM k""", PVS)
def clean_bars(spark, d):
    return epoch(cl.clean_bars(dirty_bars(spark, d)))


@query("winsorise_outliers", f"""WITH {DIRTY}, q AS (
  SELECT series_key, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi,
    quantile_cont(volume, 0.05) AS vlo, quantile_cont(volume, 0.95) AS vhi FROM dirty GROUP BY 1)
SELECT series_key, seq,
  CASE WHEN seq % 10 = 0 AND close IS NOT NULL THEN least(greatest(close, lo), hi) ELSE close END AS close,
  CASE WHEN seq % 10 = 0 AND volume IS NOT NULL THEN least(greatest(volume, vlo), vhi) ELSE volume END AS volume
FROM dirty JOIN q USING (series_key)""", "close volume")
def winsorise_outliers(spark, d):
    return cl.winsorise(dirty_bars(spark, d), ["close", "volume"], F.col("seq") % 10 == 0).select("series_key", "seq", "close", "volume")


@query("iforest_flag")
def iforest_flag(spark, d):
    out = isolation_flag(dirty_bars(spark, d), PV, ["series_key", "seq"])
    return out.select("series_key", "seq", "anomaly_score", "is_outlier")


@query("enhance")
def enhance(spark, d):
    """The whole repair, with order figures as external columns; the forest's flags have no SQL."""
    bars = dirty_bars(spark, d).join(order_days(spark, d).select("ts", "avg_price"), "ts", "left")
    out = cl.enhance(bars, "2002-01-01", ["avg_price"])
    return epoch(out).select("series_key", "ts", *PV, "avg_price", "missing_data_ratio", "data_quality_score")


# the repair step by step; prices go forward, the external column by neighbours, then everything backward, linear and by the median
ALL = [*PV, "avg_price"]
_GAP = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in P)
_BOTH = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in P)
_LINE = ("CASE WHEN {c} IS NOT NULL THEN {c} ELSE " + _FF + " + coalesce((" + _BF + " - " + _FF + ") * (i - last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER (" + SEQW + " ROWS UNBOUNDED PRECEDING)) / "
         "(first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER (" + SEQW + " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER (" + SEQW + " ROWS UNBOUNDED PRECEDING)), 0) END")
REPAIR = f"""{DIRTY}, {ORDER_DAYS},
ext AS (SELECT d.*, row_number() OVER ({SEQW}) AS i, CASE WHEN seq % 7 = 0 THEN NULL ELSE o.avg_price END AS avg_price FROM dirty d LEFT JOIN order_days o USING (ts)),
fwd AS (SELECT series_key, ts, seq, i, {_each(_FF, P)}, volume, avg_price FROM ext),
gap AS (SELECT a.series_key, a.i, b.i AS j, b.avg_price AS y, {_GAP} AS total, {_BOTH} AS present FROM fwd a JOIN fwd b USING (series_key) WHERE a.avg_price IS NULL AND b.avg_price IS NOT NULL),
rank AS (SELECT *, row_number() OVER (PARTITION BY series_key, i ORDER BY sqrt(total * 4.0::DOUBLE / present), j) AS k FROM gap WHERE present > 0),
guess AS (SELECT series_key, i, avg(y) AS guess FROM rank WHERE k <= 5 GROUP BY 1, 2),
knn AS (SELECT series_key, ts, seq, i, {COLS}, coalesce(avg_price, guess) AS avg_price FROM fwd LEFT JOIN guess USING (series_key, i)),
bwd AS (SELECT series_key, ts, seq, i, {_each(_BF, ALL)} FROM knn),
line AS (SELECT series_key, ts, seq, {_each(_LINE, ALL)} FROM bwd),
med AS (SELECT series_key, {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in ALL)} FROM line GROUP BY 1),
whole AS (SELECT l.series_key, l.ts, l.seq, {", ".join(f"coalesce(l.{c}, m.{c}) AS {c}" for c in ALL)} FROM line l JOIN med m USING (series_key))"""


@query("impute_chain_external", f"WITH {REPAIR} SELECT series_key, {TS}, seq, {', '.join(ALL)} FROM whole", " ".join(ALL), digits=4)
def impute_chain_external(spark, d):
    """Every step of the chain, with an order figure as external column."""
    return epoch(cl.impute_chain(external_bars(spark, d), ["avg_price"], order=("ts", "seq"))).select("series_key", "ts", "seq", *ALL)


def external_bars(spark, d):
    gap = F.when(F.col("seq") % 7 != 0, F.col("avg_price")).alias("avg_price")
    return dirty_bars(spark, d).join(order_days(spark, d).select("ts", "avg_price"), "ts", "left").select("series_key", "ts", "seq", *PV, gap)


@query("enhance_flagged", f"""WITH {REPAIR},
q AS (SELECT series_key, {", ".join(f"quantile_cont({c}, 0.05) AS {c}_lo, quantile_cont({c}, 0.95) AS {c}_hi" for c in PV)} FROM whole GROUP BY 1),
w AS (SELECT series_key, ts, seq, avg_price, {", ".join(f"CASE WHEN seq % 10 = 0 THEN least(greatest({c}, {c}_lo), {c}_hi) ELSE {c} END AS {c}" for c in PV)} FROM whole JOIN q USING (series_key)),
f AS (SELECT series_key, ts, seq, avg_price, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, greatest(volume, 0) AS volume FROM w)
SELECT series_key, {TS}, {", ".join(ALL)}, 0.0::DOUBLE AS missing_data_ratio, (1.0 + (CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END) + 1.0)::DOUBLE / 3 AS data_quality_score
FROM f QUALIFY row_number() OVER (PARTITION BY series_key, ts ORDER BY seq) = 1""", " ".join([*ALL, "missing_data_ratio", "data_quality_score"]), digits=4)
def enhance_flagged(spark, d):
    """The whole repair with every tenth row as an outlier."""
    out = cl.enhance(external_bars(spark, d), "2002-01-01", ["avg_price"], F.col("seq") % 10 == 0)
    return epoch(out).select("series_key", "ts", *ALL, "missing_data_ratio", "data_quality_score")


@query("row_quality", f"""WITH {DIRTY}, m AS (SELECT *,
  ((CASE WHEN open IS NULL THEN 1 ELSE 0 END) + (CASE WHEN high IS NULL THEN 1 ELSE 0 END) + (CASE WHEN low IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN close IS NULL THEN 1 ELSE 0 END) + (CASE WHEN volume IS NULL THEN 1 ELSE 0 END)) / 5.0::DOUBLE AS missing_data_ratio FROM dirty)
SELECT series_key, seq, (epoch(TIMESTAMP '2002-01-01') - epoch(ts)) / 3600 AS data_age_hours, missing_data_ratio,
  ((CASE WHEN missing_data_ratio = 0 THEN 1.0 ELSE 0.0 END) + (CASE WHEN volume > 0 THEN 1.0 ELSE 0.0 END)
   + (CASE WHEN high >= greatest(open, close) AND low <= least(open, close) THEN 1.0 ELSE 0.0 END)) / 3 AS data_quality_score
FROM m""", "data_age_hours missing_data_ratio data_quality_score")
def row_quality(spark, d):
    out = cl.row_quality(dirty_bars(spark, d), "2002-01-01 00:00:00")
    return out.select("series_key", "seq", "data_age_hours", "missing_data_ratio", "data_quality_score")


@query("time_range_filter", f"""WITH {BARS_D}, {ORDER_DAYS}, r AS (
  SELECT greatest((SELECT min(ts) FROM bars), (SELECT min(ts) FROM order_days)) AS a,
         least((SELECT max(ts) FROM bars), (SELECT max(ts) FROM order_days)) AS z)
SELECT 'bars' AS source, {TS}, count(*) AS n FROM bars, r WHERE ts BETWEEN a AND z GROUP BY ALL
UNION ALL SELECT 'orders', {TS}, count(*) FROM order_days, r WHERE ts BETWEEN a AND z GROUP BY ALL""")
def time_range_filter(spark, d):
    t = cl.common_time_range({"bars": bars_d(spark, d), "orders": order_days(spark, d)})
    parts = [epoch(x).groupBy(F.lit(n).alias("source"), "ts").agg(F.count("*").alias("n")) for n, x in t.items()]
    return parts[0].unionByName(parts[1])


@query("keyword_filter", """SELECT 'documents' AS source, doc_id AS id FROM documents
WHERE contains(lower(text), 'tion the') OR contains(lower(text), 'eaux de') OR contains(lower(source), 'src1')
UNION ALL SELECT 'conversations', conv_id * 1000 + turn FROM conversations
WHERE contains(lower(text), 'tion the') OR contains(lower(text), 'eaux de')""")
def keyword_filter(spark, d):
    words = ["tion the", "eaux de"]
    docs = table(spark, d, "documents")
    a = cl.keyword_filter(docs, ["text"], words).unionByName(cl.keyword_filter(docs, ["source"], ["src1"])).dropDuplicates(["doc_id"])
    b = cl.keyword_filter(table(spark, d, "conversations"), ["text"], words)
    return a.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id")).unionByName(
        b.select(F.lit("conversations").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    )


@query("tail_window", f"""WITH {BARS_D} SELECT series_key, {TS}, close FROM (
  SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) AS k FROM bars) WHERE k <= 96""", "close")
def tail_window(spark, d):
    from tideline.operators.splits import tail_rows

    return epoch(tail_rows(bars_d(spark, d), 96)).select("series_key", "ts", "close")


@query("sort_series", f"WITH {BARS_D} SELECT series_key, {TS}, close FROM bars ORDER BY 1, 2", "close")
def sort_series(spark, d):
    return epoch(bars_d(spark, d).orderBy("series_key", "ts").select("series_key", "ts", "close"))


@query("tick_ordinal", f"WITH {EVENT_TICKS} SELECT series_key, seq, row_number() OVER (PARTITION BY series_key ORDER BY seq) AS rn FROM event_ticks")
def tick_ordinal(spark, d):
    """Row numbers of hot series, counted per slice of bounded rows and prefix-summed."""
    return ordinal(event_ticks(spark, d), ["series_key"], ["seq"], Slices(3600, TICKS)).select("series_key", "seq", "rn")


