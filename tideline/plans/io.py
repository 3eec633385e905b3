"""Queries: sources, sinks and streams. Tables go to the shared folder and are read back."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tideline.operators import quality as qu
from tideline.operators import selection as sel
from tideline.plans.inputs import (
    BARS_D, EVENT_TICKS, FORECASTS, POSTS, TRIALS, bars_d, epoch, forecasts, table, trials,
)
from tideline.plans.quality import _ALL as CHECKS_SQL
from tideline.plans.quality import EXT, M, rows
from tideline.plans.registry import query
from tideline.session import shared_folder
from tideline.sources import fetch as fe
from tideline.sources import readers as rd
from tideline.sources import writers as wr
from tideline.streaming import jobs

TS = "epoch(ts)::BIGINT AS ts"


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _flat(b):
    return b.select(F.col("series_key").cast("string").alias("series_key"), F.unix_timestamp("ts").alias("timestamp"), "open", "close", "high", "low", "volume")


_BARS = f"WITH {BARS_D} SELECT series_key::VARCHAR AS series_key, epoch(ts)::BIGINT AS timestamp, open, close, high, low, volume FROM bars"
_OHLCV = "open close high low volume"


@query("scan_bars", _BARS, _OHLCV)
def scan_bars(spark, d):
    path = fresh(spark, "bars-csv")
    wr.sink_table(_flat(bars_d(spark, d)), path, "csv")
    return rd.scan_bars(spark, path).drop("ts")


@query("scan_any", _BARS, _OHLCV)
def scan_any(spark, d):
    path = fresh(spark, "bars") + "/bars.json"
    wr.sink_table(_flat(bars_d(spark, d)), path, "json")
    return rd.scan_any(spark, path, rd.BAR_SCHEMA)


@query("sink_table", f"WITH {BARS_D} SELECT series_key, {TS}, open, high, low, close, volume FROM bars", _OHLCV)
def sink_table(spark, d):
    path = fresh(spark, "bars-parquet")
    wr.sink_table(bars_d(spark, d), path, "parquet", buckets=8)
    return epoch(spark.read.parquet(path)).drop("series_bucket")


@query("scan_results_dir", f"WITH {FORECASTS} SELECT model, series_key, t, predicted FROM forecasts", "predicted")
def scan_results_dir(spark, d):
    path = fresh(spark, "results")
    forecasts(spark, d).select("model", "series_key", "t", "predicted").write.partitionBy("model").option("header", True).csv(path)
    return rd.scan_results_dir(spark, f"{path}/model=*/*.csv", "series_key BIGINT, t BIGINT, predicted DOUBLE")


@query("union_results", f"WITH {FORECASTS} SELECT series_key, t, predicted, CASE WHEN model = 'naive' THEN actual END AS actual FROM forecasts WHERE model <> 'trend5'", "predicted actual")
def union_results(spark, d):
    f = forecasts(spark, d)
    a = f.where("model = 'naive'").select("series_key", "t", "predicted", "actual")
    return wr.union_results([a, f.where("model = 'mean10'").select("series_key", "t", "predicted")])


@query("scan_trial_json", f"WITH {TRIALS} SELECT study, trial_id, value, training_time, status, layers, model FROM trials", "value training_time")
def scan_trial_json(spark, d):
    """Trials written as JSON documents of at most 4096 trial numbers each, then read and exploded."""
    path = fresh(spark, "trials-json")
    t = trials(spark, d).withColumn("part", F.floor(F.col("trial_id") / 4096))
    docs = t.groupBy("study", "part").agg(F.collect_list(F.struct("trial_id", "params", "value", "training_time", "status")).alias("trials"))
    docs.drop("part").write.json(path)
    r = rd.scan_trial_json(spark, path)
    return r.select("study", "trial_id", "value", "training_time", "status", F.element_at("params", F.lit("layers")).alias("layers"), F.element_at("params", F.lit("model")).alias("model"))


_NAME = """CASE WHEN p_partkey % 10 = 0 THEN 'no run' ELSE p_brand || '_L' || (p_size % 32) || '_' || CASE p_size % 3 WHEN 0 THEN '1h' WHEN 1 THEN '15min' ELSE '1D' END || '_' || CASE p_size % 2 WHEN 0 THEN 'M' ELSE 'MS' END
  || '_seq' || (p_partkey % 512) || '_pred' || (p_partkey % 96) || '_p' || (p_size % 16) || '_s' || (p_size % 8) || '_v' || (p_partkey % 1000) END"""
_PATTERN = r"^(.+?)_L(\d+)_(.+?)_([A-Z]+)_seq(\d+)_pred(\d+)_p(\d+)_s(\d+)_v(\d+)"


def run_names(spark, d):
    p = table(spark, d, "part")
    s = F.col("p_size")
    text = lambda c: c.cast("string")
    name = F.concat(
        "p_brand", F.lit("_L"), text(s % 32), F.lit("_"), F.when(s % 3 == 0, "1h").when(s % 3 == 1, "15min").otherwise("1D"), F.lit("_"),
        F.when(s % 2 == 0, "M").otherwise("MS"), F.lit("_seq"), text(F.col("p_partkey") % 512), F.lit("_pred"), text(F.col("p_partkey") % 96),
        F.lit("_p"), text(s % 16), F.lit("_s"), text(s % 8), F.lit("_v"), text(F.col("p_partkey") % 1000),
    )
    return p.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "no run").otherwise(name).alias("run_name"))


def _group(i: int) -> str:
    return f"nullif(regexp_extract(run_name, '{_PATTERN}', {i}), '')"


@query("parse_run_id", f"WITH r AS (SELECT p_partkey, {_NAME} AS run_name FROM part) SELECT p_partkey, "
       + ", ".join(f"{_group(i)}{'' if n in ('llm', 'granularity', 'features') else '::INT'} AS {n}" for i, n in enumerate(rd.RUN_FIELDS, 1)) + " FROM r")
def parse_run_id(spark, d):
    return rd.parse_run_id(run_names(spark, d), "run_name").drop("run_name")


def log_lines(spark, d):
    o = table(spark, d, "orders")
    k, v = F.col("o_orderkey"), (F.col("o_totalprice") / 100000).cast("string")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit('FINAL_METRICS:{"mae": '), v, F.lit(', "mse": '), (k % 100).cast("string"), F.lit("}")))
        .when(k % 5 == 1, F.concat(F.lit("Epoch 3 | MAE: "), v, F.lit(", mse: "), (k % 77).cast("string"), F.lit(".5")))
        .when(k % 5 == 2, F.concat(F.lit("vali mape: "), v))
        .otherwise(F.lit("saving checkpoint ..."))
    )
    return o.select(F.col("o_custkey").alias("run"), k.alias("line_no"), line.alias("line"))


@query("parse_metric_log", r"""WITH l AS (SELECT o_custkey AS run, o_orderkey AS k, o_totalprice / 100000 AS v FROM orders)
SELECT run, coalesce(arg_min(v, k) FILTER (k % 5 = 0), arg_max(v, k) FILTER (k % 5 = 1), 999.0) AS mae,
  coalesce(arg_min(k % 100, k) FILTER (k % 5 = 0), arg_max(k % 77 + 0.5, k) FILTER (k % 5 = 1), 999.0) AS mse,
  coalesce(arg_max(v, k) FILTER (k % 5 = 2), 999.0) AS mape FROM l GROUP BY 1""", "mae mse mape")
def parse_metric_log(spark, d):
    return rd.parse_metric_log(log_lines(spark, d))


@query("scan_templates", "SELECT doc_id::VARCHAR AS name, length(trim(text, ' ')) AS n_chars FROM documents")
def scan_templates(spark, d):
    """A prompt bank with a text for every document."""
    path = fresh(spark, "prompt-bank")
    docs = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\u0001"), "text").alias("value"))
    docs.write.option("lineSep", "\u0002").text(path)
    t = rd.scan_template_bank(spark, path)
    return t.select("name", F.length("template").cast("bigint").alias("n_chars"))


@query("sink_report_json", f"WITH {M} SELECT series_key, check_name, score, severity FROM ({CHECKS_SQL})", "score")
def sink_report_json(spark, d):
    path = fresh(spark, "quality-json")
    wr.sink_report_json(qu.quality_checks(qu.measure(rows(spark, d), external=EXT), external=EXT), path)
    return spark.read.schema("series_key BIGINT, check_name STRING, score DOUBLE, severity STRING").json(path)


@query("sink_selection", f"WITH {BARS_D} SELECT 'open' AS feature, abs(corr(open, close)) AS abs_r FROM bars UNION ALL SELECT 'high', abs(corr(high, close)) FROM bars UNION ALL SELECT 'low', abs(corr(low, close)) FROM bars", "abs_r")
def sink_selection(spark, d):
    path = fresh(spark, "selection")
    wr.sink_selection(sel.target_corr(bars_d(spark, d), ["open", "high", "low"], "close"), path)
    return wr.load_selection(spark, path)


@query("append_run_log", f"WITH r AS (SELECT {_NAME} AS model_id, p_size, p_partkey FROM part) SELECT model_id, p_size::DOUBLE AS duration_seconds, CASE WHEN p_partkey % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, "
       f"{_group(5).replace('run_name', 'model_id')}::INT AS seq_len FROM r", "duration_seconds")
def append_run_log(spark, d):
    """Two batches of parsed runs appended to one log."""
    path = fresh(spark, "run-log")
    names = run_names(spark, d).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    runs = rd.parse_run_id(names, "run_name").withColumnsRenamed({"run_name": "model_id", "llm": "llm_model", "layers": "llm_layers", "vocab": "num_tokens", "p_size": "duration_seconds"})
    failed = F.col("p_partkey") % 10 == 0
    wr.append_run_log(runs.where(failed).withColumn("status", F.lit("failed")), path)
    wr.append_run_log(runs.where(~failed).withColumn("status", F.lit("completed")), path)
    return spark.read.parquet(path).select("model_id", "duration_seconds", "status", "seq_len")


# --- streams: the batch operators on a file stream of events -----------------------------

def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d)


_FINAL = "ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("stream_resample_bars", f"""WITH {EVENT_TICKS}, b AS (SELECT series_key, date_trunc('hour', ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, sum(qty) AS volume FROM event_ticks GROUP BY 1, 2) SELECT * REPLACE (epoch(ts)::BIGINT AS ts) FROM b WHERE {_FINAL}""", "open high low close volume")
def stream_resample_bars(spark, d):
    """Hourly bars of the event stream; the bars the watermark has passed are final."""
    path = fresh(spark, "stream-bars")
    e = _event_stream(spark, d).select(
        F.col("event_type").alias("series_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty")
    )
    jobs.run_available(jobs.stream_bars(e, "1h"), path)
    return epoch(spark.read.parquet(f"{path}/table"))


@query("stream_post_rollup", f"""WITH {POSTS}, h AS (SELECT date_trunc('hour', ts) AS ts, coalesce((avg(polarity) + 1) / 2, 0.5) AS sentiment_score, count(polarity) AS post_count,
  coalesce(avg(score), 0.5) AS avg_score FROM posts GROUP BY 1) SELECT * REPLACE (epoch(ts)::BIGINT AS ts) FROM h WHERE {_FINAL}""", "sentiment_score avg_score")
def stream_post_rollup(spark, d):
    path = fresh(spark, "stream-posts")
    k = F.get_json_object("props", "$.k").cast("double")
    p = _event_stream(spark, d).select(
        F.col("ts").cast("timestamp").alias("ts"), ((k - 50) / 50).alias("polarity"), (k / 100).alias("subjectivity"), F.col("value").alias("score"),
        (F.col("user_id") % 40).cast("double").alias("comments"), (F.lit(1.0) / (1 + F.col("value"))).alias("upvote_ratio"),
    )
    jobs.run_available(jobs.stream_post_rollup(p), path)
    return epoch(spark.read.parquet(f"{path}/table")).select("ts", "sentiment_score", "post_count", "avg_score")


# --- sources by time range and datasets by name ---------------------------------------------

def event_slices(d) -> fe.SlicedSource:
    """Events as a service that is asked for one day at a time."""

    def fetch_data(start, end):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        a, b = (pa.scalar(t.replace(tzinfo=None), pa.timestamp("us")) for t in (start, end))
        rows = ds.dataset(f"{d}/events.parquet").to_table(columns=["ts", "event_id", "event_type", "value"], filter=(pc.field("ts") >= a) & (pc.field("ts") < b))
        yield from rows.set_column(0, "ts", rows.column("ts").cast(pa.timestamp("us", tz="UTC"))).to_batches()

    first, last = datetime(2023, 12, 1), datetime(2024, 3, 1)
    return fe.SlicedSource("event_slices", "ts timestamp, event_id bigint, event_type string, value double", fetch_data, first, last, timedelta(days=5))


def order_files(d) -> fe.TableSource:
    return fe.TableSource(f"{d}/orders.parquet", "o_orderdate", (("price", "o_totalprice"), ("status", "o_orderstatus")))


def datasets(d) -> fe.Datasets:
    """Preparations of the sources of ``d`` by name."""
    sets = fe.Datasets()

    @sets.register("orders")
    def orders(spark, start, end):
        return order_files(d).fetch(spark, start, end)

    @sets.register("orders_by_day")
    def orders_by_day(spark, start, end, status=None):
        rows = orders(spark, start, end)
        rows = rows if status is None else rows.where(F.col("status") == status)
        return rows.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.count("*").alias("n"), F.avg("price").alias("level"))

    @sets.register("events_by_hour")
    def events_by_hour(spark, start, end):
        rows = event_slices(d).fetch(spark, start, end)
        return rows.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count("*").alias("n"), F.avg("value").alias("level"))

    return sets


@query("source_range", """SELECT 'orders' AS source, epoch(o_orderdate)::BIGINT AS ts, o_totalprice AS value FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-03-01 12:00:00' AND o_orderdate < TIMESTAMP '1999-03-01'
UNION ALL SELECT 'events', floor(epoch(ts))::BIGINT, value FROM events WHERE ts >= TIMESTAMP '2024-01-04 06:00:00' AND ts < TIMESTAMP '2024-01-20'""", "value")
def source_range(spark, d):
    """Rows of one time range of each source: of the files by the scan's filter, of the slices by the calls that are made."""
    o = order_files(d).fetch(spark, datetime(1996, 3, 1, 12), datetime(1999, 3, 1)).select(F.lit("orders").alias("source"), "ts", F.col("price").alias("value"))
    e = event_slices(d).fetch(spark, datetime(2024, 1, 4, 6), datetime(2024, 1, 20)).select(F.lit("events").alias("source"), "ts", "value")
    return epoch(o.unionByName(e))


@query("dataset_registry", """SELECT 'orders_by_day' AS dataset, epoch(date_trunc('day', o_orderdate))::BIGINT AS ts, count(*) AS n, avg(o_totalprice) AS level FROM orders GROUP BY ALL
UNION ALL SELECT 'finished_by_day', epoch(date_trunc('day', o_orderdate))::BIGINT, count(*), avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL
UNION ALL SELECT 'events_by_hour', epoch(date_trunc('hour', ts))::BIGINT, count(*), avg(value) FROM events GROUP BY ALL""", "level", digits=4)
def dataset_registry(spark, d):
    """Whole datasets by name, one with a setting of its preparation."""
    sets, start, end = datasets(d), datetime(1990, 1, 1), datetime(2030, 1, 1)
    asked = {"orders_by_day": ("orders_by_day", {}), "finished_by_day": ("orders_by_day", {"status": "F"}), "events_by_hour": ("events_by_hour", {})}
    parts = [sets.load(spark, name, start, end, **more).select(F.lit(n).alias("dataset"), "ts", "n", "level") for n, (name, more) in asked.items()]
    return epoch(parts[0].unionByName(parts[1]).unionByName(parts[2]))


_HOURLY_EVENTS = "(SELECT date_trunc('hour', ts) AS ts, count(*) AS n, avg(value) AS level FROM events GROUP BY 1)"


@query("source_aligned", f"""WITH {EVENT_TICKS}, h AS {_HOURLY_EVENTS}, o AS (SELECT o_orderdate + INTERVAL 8500 DAY AS ts, o_totalprice AS price, o_orderkey AS seq FROM orders),
x AS (SELECT ts, arg_max(price, seq) AS price FROM o GROUP BY 1)
SELECT h.series_key, h.seq, e.n_events, e.level, x.price FROM (SELECT * FROM event_ticks WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25') h
ASOF LEFT JOIN (SELECT ts + INTERVAL 1 HOUR AS ts, n AS n_events, level FROM (SELECT * FROM {_HOURLY_EVENTS} WHERE ts >= TIMESTAMP '2024-01-01')) e ON h.ts >= e.ts
ASOF LEFT JOIN x ON h.ts >= x.ts""", "level price", digits=4)
def source_aligned(spark, d):
    """Ticks of a range with the last closed hour of the event service and the last order, both fetched by time range."""

    class Hours:
        def fetch(self, spark, start, end):
            hours = datasets(d).load(spark, "events_by_hour", start, end)
            return hours.select((F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.col("n").alias("n_events"), "level")

    class Orders:
        """Orders as if they came 8500 days later; the last one of a moment counts."""

        def fetch(self, spark, start, end):
            late = timedelta(days=8500)
            rows = fe.TableSource(f"{d}/orders.parquet", "o_orderdate", (("price", "o_totalprice"), ("seq", "o_orderkey"))).fetch(spark, datetime(1990, 1, 1), end - late)
            return rows.select((F.col("ts") + F.expr("INTERVAL 8500 DAYS")).alias("ts"), "seq", "price")

    ticks = table(spark, d, "events").select(F.col("event_type").alias("series_key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    out = fe.aligned(spark, ticks, {"hours": Hours(), "orders": Orders()}, datetime(2024, 1, 3), datetime(2024, 1, 25), timedelta(days=2))
    return out.select("series_key", F.col("id").alias("seq"), "n_events", "level", "price")
