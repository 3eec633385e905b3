"""The two batch operators that also run on streams: bars from ticks, hourly post rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.bars import resample_bars
from tideline.operators.rollups import post_rollup


def stream_bars(ticks: DataFrame, every: str, delay: str = "2 hours") -> DataFrame:
    """Bars of a tick stream; a bar is final once the watermark passes its end."""
    return resample_bars(ticks.withWatermark("ts", delay), every)


def stream_post_rollup(posts: DataFrame, delay: str = "2 hours") -> DataFrame:
    rolled = post_rollup(posts.withWatermark("ts", delay), F.window("ts", "1 hour"))
    return rolled.withColumn("ts", F.col("ts.start"))


def run_available(stream: DataFrame, path: str) -> None:
    """Process what is there and stop; output and progress live in the given folder."""
    q = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
