"""Session settings the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: every timestamp in this library is UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application that the driver and every executor can reach.

    It lies in ``spark.checkpoint.dir``, or in the warehouse folder where the session names no
    checkpoint folder; a cluster shares both. A machine-local temporary folder is never used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    named = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tideline-work"
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Paths of the tables written inside the innermost ``written_alone``.
_on_the_way: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that this application wrote into its shared folder."""
    _delete(spark, shared_folder(spark))


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    Cuts the lineage between steps that read their input more than once; unlike a cache the
    table survives the loss of executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _on_the_way.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(spark: SparkSession, build: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """``written(build())``; the tables that ``build`` wrote on its way are deleted once that is done.

    So ``build`` must not hand them to anyone else.
    """
    paths: list[str] = []
    token = _on_the_way.set(paths)
    try:
        df = build()
    finally:
        _on_the_way.reset(token)
    out = written(df, name)
    for path in paths:
        _delete(spark, path)
    return out


def local_session(cores: str = "8", app: str = "tideline", folder: str = "/tmp/tideline-work") -> SparkSession:
    """Single-machine session for tests and the benchmark; ``folder`` takes its intermediate tables."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
