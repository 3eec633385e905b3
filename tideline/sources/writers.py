"""Sinks: tables, reports, selections and the run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the run log.
RUN_LOG = [
    ("timestamp", "bigint"), ("model_id", "string"), ("llm_model", "string"), ("llm_layers", "int"), ("granularity", "string"),
    ("task_name", "string"), ("features", "string"), ("seq_len", "int"), ("pred_len", "int"), ("patch_len", "int"), ("stride", "int"),
    ("num_tokens", "int"), ("duration_seconds", "double"), ("metrics", "string"), ("status", "string"),
]


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", buckets: int | None = None, key: str = "series_key", mode: str = "overwrite") -> None:
    """Write a table, by default in one folder, or in folders by hashed key.

    The rebalance hint lets AQE merge small and split large output partitions, so a hot key
    ends up in several files of its folder instead of one huge task.
    """
    if buckets:
        df = df.withColumn("series_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).hint("rebalance", "series_bucket")
        writer = df.write.partitionBy("series_bucket")
    else:
        writer = df.write
    options = {"header": "true"} if fmt == "csv" else {}
    writer.format(fmt).mode(mode).options(**options).save(path)


def sink_report_json(report: DataFrame, path: str) -> None:
    """One JSON line per check or figure."""
    report.write.mode("overwrite").json(path)


def sink_selection(scores: DataFrame, path: str) -> None:
    """Selected features with scores: a row per feature, one file."""
    scores.coalesce(1).write.mode("overwrite").json(path)


def load_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature STRING, abs_r DOUBLE").json(path)


def append_run_log(runs: DataFrame, path: str) -> None:
    """Append a batch of runs in the fixed column order; missing columns stay empty."""
    cols = [(F.col(n) if n in runs.columns else F.lit(None)).cast(t).alias(n) for n, t in RUN_LOG]
    runs.select(*cols).write.mode("append").parquet(path)


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate result tables whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
