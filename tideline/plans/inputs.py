"""Input relations the registered queries share, as DataFrames and as SQL.

Bars are unique per (series_key, slot). With daily and hourly slots that bounds the rows of
one series (a century of hours is below ``ordered.PLAIN_WINDOW_ROWS``), whatever share of the
ticks one series holds, so queries over bars use plain windows. Queries over ticks and trial
logs, where one key may hold any share, pass a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.bars import resample_bars

#: Ticks of one series that a slice of the time axis holds at most.
TICKS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as whole Unix seconds, the exchange format of the bar tables."""
    return df.withColumns({c: F.unix_timestamp(c) for c in (columns or ("ts",))})


# --- ticks and bars --------------------------------------------------------------------

def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per line item: unit price of a supplier, in whole cents."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series_key"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + F.col("l_partkey") % 1048576).alias("seq"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"),
        F.col("l_quantity").alias("qty"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: five hot series, any number of rows each."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("qty"),
    )


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_bars(line_ticks(spark, sf_dir), "1D")


def bars_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_bars(event_ticks(spark, sf_dir), "1h")


LINE_TICKS = """line_ticks AS (
  SELECT l_suppkey AS series_key, l_shipdate AS ts,
         (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS seq,
         floor(l_extendedprice * 100 / l_quantity) / 100 AS price, l_quantity AS qty
  FROM lineitem)"""
EVENT_TICKS = """event_ticks AS (
  SELECT event_type AS series_key, ts, event_id AS seq, value AS price, 1.0::DOUBLE AS qty FROM events)"""


def sql_bars(source: str, unit: str, name: str) -> str:
    return f"""{name} AS (
  SELECT series_key, date_trunc('{unit}', ts) AS ts, arg_min(price, seq) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume
  FROM {source} GROUP BY 1, 2)"""


BARS_D = LINE_TICKS + ",\n" + sql_bars("line_ticks", "day", "bars")
BARS_H = EVENT_TICKS + ",\n" + sql_bars("event_ticks", "hour", "bars_h")

# --- damaged bars ----------------------------------------------------------------------

def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with planted faults, chosen by position: NULLs, negative volume, swapped
    high and low, tenfold price, duplicate timestamps; ``seq`` is the arrival order."""
    from tideline.functions.rolling import series_window

    b = bars_d(spark, sf_dir).withColumn("bar_no", F.row_number().over(series_window(["series_key"])).cast("bigint"))
    h = (F.col("bar_no") * 31 + F.col("series_key") * 17) % 100
    b = b.withColumn("h", h)
    b = b.select(
        "series_key", "ts", "bar_no", "h",
        F.when(F.col("h") == 3, None).otherwise(F.col("open")).alias("open"),
        F.when(F.col("h") == 5, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(F.col("h") == 5, F.col("high")).otherwise(F.col("low")).alias("low"),
        F.when(F.col("h") == 7, None).when(F.col("h") == 11, F.col("close") * 10).otherwise(F.col("close")).alias("close"),
        F.when(F.col("h") == 13, -F.col("volume")).when(F.col("h") == 17, None).otherwise(F.col("volume")).alias("volume"),
    )
    copies = F.when(F.col("h") == 19, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = b.withColumn("copy", F.explode(copies))
    return b.select(
        "series_key", "ts", (F.col("bar_no") * 2 + F.col("copy")).alias("seq"),
        "open", "high", "low", "close", "volume",
    )


DIRTY = BARS_D + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) AS bar_no FROM bars),
hashed AS (SELECT *, (bar_no * 31 + series_key * 17) % 100 AS h FROM numbered),
damaged AS (
  SELECT series_key, ts, bar_no, h,
    CASE WHEN h = 3 THEN NULL ELSE open END AS open,
    CASE WHEN h = 5 THEN low ELSE high END AS high,
    CASE WHEN h = 5 THEN high ELSE low END AS low,
    CASE WHEN h = 7 THEN NULL WHEN h = 11 THEN close * 10 ELSE close END AS close,
    CASE WHEN h = 13 THEN -volume WHEN h = 17 THEN NULL ELSE volume END AS volume
  FROM hashed),
dirty AS (
  SELECT series_key, ts, bar_no * 2 + copy AS seq, open, high, low, close, volume
  FROM damaged, (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR h = 19)"""

# --- slower sources --------------------------------------------------------------------

def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily figures from orders: a source without series, slower than the bars."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts"))
        .agg(
            F.avg("o_totalprice").alias("avg_price"),
            F.count("*").alias("n_orders"),
            F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0)).alias("filled"),
        )
    )


ORDER_DAYS = """order_days AS (
  SELECT date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) AS avg_price, count(*) AS n_orders,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS filled
  FROM orders GROUP BY 1)"""

# --- calm prices and forecasts of simple models, long form --------------------------------

def calm_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars on a narrow price scale (10000 + price / 100), so that products of returns stay small."""
    scale = {c: F.col(c) / 100 + 10000 for c in ("open", "high", "low", "close")}
    return bars_d(spark, sf_dir).withColumns(scale)


CALM = BARS_D + """,
calm AS (SELECT series_key, ts, open / 100 + 10000 AS open, high / 100 + 10000 AS high, low / 100 + 10000 AS low,
  close / 100 + 10000 AS close, volume FROM bars)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, series_key, ts, t, actual, predicted): last value, mean of 10, 5-step trend."""
    from tideline.functions.rolling import series_window

    w = series_window(["series_key"])
    b = calm_bars(spark, sf_dir).select("series_key", "ts", F.col("close").alias("actual"))
    b = b.withColumns(
        {
            "t": F.row_number().over(w).cast("bigint"),
            "naive": F.lag("actual").over(w),
            "mean10": F.avg("actual").over(w.rowsBetween(-10, -1)),
            "trend5": F.lag("actual").over(w) + (F.lag("actual").over(w) - F.lag("actual", 6).over(w)) / 5,
        }
    ).where("t > 10")
    # a broadcast of the names keeps the rows of a series where they are, so windows by model and series need no exchange; an unpivot does not
    models = spark.sql("SELECT * FROM VALUES ('naive'), ('mean10'), ('trend5') AS m(model)")
    predicted = F.when(F.col("model") == "naive", F.col("naive")).when(F.col("model") == "mean10", F.col("mean10")).otherwise(F.col("trend5"))
    return b.crossJoin(F.broadcast(models)).select("series_key", "ts", "t", "actual", "model", predicted.alias("predicted"))


FORECASTS = CALM + """,
based AS (
  SELECT series_key, ts, close AS actual, row_number() OVER w AS t, lag(close) OVER w AS naive,
    avg(close) OVER (PARTITION BY series_key ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean10,
    lag(close) OVER w + (lag(close) OVER w - lag(close, 6) OVER w) / 5 AS trend5
  FROM calm WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
forecasts AS (
  SELECT series_key, ts, t, actual, model, predicted FROM (
    SELECT series_key, ts, t, actual, 'naive' AS model, naive AS predicted FROM based UNION ALL
    SELECT series_key, ts, t, actual, 'mean10', mean10 FROM based UNION ALL
    SELECT series_key, ts, t, actual, 'trend5', trend5 FROM based) WHERE t > 10)"""

# --- trial log -------------------------------------------------------------------------

def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a trial log: five studies with any number of trials; trial_id is unique."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("study"),
        F.col("o_orderkey").alias("trial_id"),
        F.create_map(
            F.lit("layers"), (F.col("o_custkey") % 5).cast("string"),
            F.lit("rate"), (F.col("o_custkey") % 7 / 100.0).cast("string"),
            F.lit("model"), F.col("o_orderstatus"),
            F.lit("fixed"), F.lit("1"),
        ).alias("params"),
        (F.col("o_totalprice") / 100000).alias("value"),
        (F.col("o_custkey") % 97 + 1).cast("double").alias("training_time"),
        F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise("completed").alias("status"),
    )


TRIALS = """trials AS (
  SELECT o_orderpriority AS study, o_orderkey AS trial_id,
         CAST(o_custkey % 5 AS VARCHAR) AS layers, CAST(o_custkey % 7 / 100.0 AS DOUBLE) AS rate, o_orderstatus AS model,
         o_totalprice / 100000 AS value, CAST(o_custkey % 97 + 1 AS DOUBLE) AS training_time,
         CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'completed' END AS status
  FROM orders)"""

# --- posts and news --------------------------------------------------------------------

def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as forum posts: polarity in [-1, 1] and engagement numbers."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").alias("post_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("forum"),
        ((k - 50) / 50).alias("polarity"),
        (k / 100).alias("subjectivity"),
        F.col("value").alias("score"),
        (F.col("user_id") % 40).cast("double").alias("comments"),
        (F.lit(1.0) / (1 + F.col("value"))).alias("upvote_ratio"),
    )


POSTS = """posts AS (
  SELECT event_id AS post_id, ts, event_type AS forum, (k - 50) / 50 AS polarity, k / 100 AS subjectivity, value AS score,
         CAST(user_id % 40 AS DOUBLE) AS comments, 1.0::DOUBLE / (1 + value) AS upvote_ratio
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""
