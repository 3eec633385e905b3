"""Readers: bars, panels, result files, trial logs, log lines and run names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.nulls import nan_to_null
from tideline.operators.bars import BAR_COLUMNS, require_bar_columns

BAR_SCHEMA = T.StructType(
    [T.StructField("series_key", T.StringType()), T.StructField("timestamp", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)


def scan_bars(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = BAR_SCHEMA) -> DataFrame:
    """Bars with a fixed schema (no inference pass), columns checked, NaN turned to NULL.

    With a CSV header Spark matches the schema by position; ``enforceSchema=false`` makes it
    check the names instead of trusting the order.
    """
    reader = spark.read.schema(schema) if fmt == "csv" else spark.read
    df = reader.format(fmt).options(header=True, enforceSchema=False).load(path) if fmt == "csv" else reader.format(fmt).load(path)
    df = nan_to_null(require_bar_columns(df))
    return df.withColumn("ts", F.timestamp_seconds("timestamp"))


def scan_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV or JSON by extension; anything else is refused."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in ("csv", "json"):
        raise ValueError(f"unsupported file type {ext!r}: csv or json")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.csv(path, header=True, inferSchema=schema is None) if ext == "csv" else reader.json(path))


def panel_to_long(panel: DataFrame, values: str, keys: Sequence[str]) -> DataFrame:
    """One row per series and step, missing values dropped; ``t`` counts from 1."""
    long = panel.select(*keys, F.posexplode(values).alias("t", "value"))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("t", F.col("t") + 1)


def scan_results_dir(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All result CSVs under a glob, with the model named by its folder or file."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"model=([^/]+)/", 1)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_results)?\.csv$", 1)
    return df.select("*", F.when(name != "", name).otherwise(stem).alias("model"))


TRIAL_SCHEMA = "study STRING, trials ARRAY<STRUCT<trial_id BIGINT, params MAP<STRING,STRING>, value DOUBLE, training_time DOUBLE, status STRING>>"


def scan_trial_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Study files, one JSON document per study part, exploded to one row per trial."""
    df = spark.read.schema(TRIAL_SCHEMA).json(path, multiLine=multi_line)
    return df.select("study", F.explode("trials").alias("t")).select("study", "t.*")


# Fixed value: the shape of a run name, e.g. GPT2_L6_1h_M_seq96_pred24_p16_s8_v1000
RUN_ID = r"^(.+?)_L(\d+)_(.+?)_([A-Z]+)_seq(\d+)_pred(\d+)_p(\d+)_s(\d+)_v(\d+)"
RUN_FIELDS = ["llm", "layers", "granularity", "features", "seq_len", "pred_len", "patch_len", "stride", "vocab"]


def parse_run_id(df: DataFrame, column: str) -> DataFrame:
    """Nine fields of a run name; NULL where it does not have that shape."""
    out = {}
    for i, n in enumerate(RUN_FIELDS, 1):
        x = F.regexp_extract(column, RUN_ID, i)
        x = F.when(x != "", x)
        out[n] = x if n in ("llm", "granularity", "features") else x.cast("int")
    return df.withColumns(out)


def parse_metric_log(lines: DataFrame, run: str = "run", line_no: str = "line_no", line: str = "line", default: float = 999.0) -> DataFrame:
    """mae, mse and mape per run: from its first ``FINAL_METRICS:{json}`` line if there is one,
    else the last ``name: value`` tokens; ``default`` when a run reports none.

    Each line is parsed where it lies; the pick per run is a map-side aggregate.
    """
    final = F.from_json(F.regexp_extract(line, r"^FINAL_METRICS:\s*(\{.*\})", 1), "mae DOUBLE, mse DOUBLE, mape DOUBLE")

    def token(n: str) -> Column:
        return F.expr(f"try_cast(regexp_extract(lower({line}), '(^|[^a-z]){n}:\\\\s*([0-9.]+)', 2) AS DOUBLE)")

    d = lines.withColumn("__f", final)
    aggs = []
    for n in ("mae", "mse", "mape"):
        f, t = F.col("__f").getField(n), token(n)
        aggs += [F.min_by(f, F.when(f.isNotNull(), F.col(line_no))).alias(f"__f_{n}"), F.max_by(t, F.when(t.isNotNull(), F.col(line_no))).alias(f"__t_{n}")]
    out = d.groupBy(run).agg(*aggs)
    return out.select(run, *[F.coalesce(f"__f_{n}", f"__t_{n}", F.lit(default)).alias(n) for n in ("mae", "mse", "mape")])


def scan_template_bank(spark: SparkSession, path: str, line_sep: str = "\u0002", name_sep: str = "\u0001", shared_prefix: str = "ETT") -> DataFrame:
    """Texts of files that hold many: each ends with ``line_sep`` and begins with its name and ``name_sep``."""
    t = spark.read.option("lineSep", line_sep).text(path)
    name = F.substring_index("value", name_sep, 1)
    text = F.substr("value", F.instr("value", name_sep) + 1)
    return t.select(F.when(name.startswith(shared_prefix), shared_prefix).otherwise(name).alias("name"), F.trim(text).alias("template"))


def scan_templates(spark: SparkSession, path: str, shared_prefix: str = "ETT", name_pattern: str = r"([^/]+)\.[^/.]*$") -> DataFrame:
    """One text per file, named by the path; names with the shared prefix read the same text."""
    t = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1)
    return t.select(F.when(name.startswith(shared_prefix), shared_prefix).otherwise(name).alias("name"), F.trim("value").alias("template"))


