"""Bars from ticks, bar-table shape and granularities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["series_key"]
PRICES = ["open", "high", "low", "close"]
BAR_COLUMNS = ["open", "close", "high", "low", "volume"]

# Cadences and how many steps of each child make one step of the parent.
CADENCE_SECONDS = {
    "1min": 60, "5min": 300, "15min": 900, "1h": 3600, "4h": 14400, "1D": 86400, "1W": 604800,
}
_DURATION = {
    "1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "1h": "1 hour",
    "4h": "4 hours", "1D": "1 day", "1W": "7 days",
}


def duration(every: str) -> str:
    if every not in _DURATION:
        raise ValueError(f"unknown granularity {every!r}; one of {sorted(_DURATION)}")
    return _DURATION[every]


def slot(every: str, ts: str = "ts") -> Column:
    """Event-time window of a bar; weeks start on Monday."""
    if every == "1W":
        return F.window(F.col(ts), "7 days", None, "4 days")
    return F.window(F.col(ts), duration(every))


def resample_bars(ticks: DataFrame, every: str, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """OHLCV bars from ticks ``(keys, ts, seq BIGINT, price, qty)``.

    Open and close follow ``seq``, the feed's sequence number. It is one BIGINT on purpose:
    with a primitive ordering the partial aggregate is a hash aggregate, with a struct it
    would sort the whole input first. Partial aggregation makes a hot key harmless: what is
    shuffled is at most one row per (key, bar) and input partition. On a stream the grouping
    keeps the window column, which the watermark needs; otherwise its start, which is half as wide.
    """
    bar = slot(every)
    return (
        ticks.groupBy(*keys, (bar if ticks.isStreaming else bar["start"]).alias("bar"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").alias("volume"),
        )
        .select(*keys, F.col("bar.start" if ticks.isStreaming else "bar").alias("ts"), "open", "high", "low", "close", "volume")
    )


def require_bar_columns(df: DataFrame) -> DataFrame:
    """Fail early when a bar column is missing, then put the columns in standard order."""
    missing = [c for c in ["timestamp", *BAR_COLUMNS] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    lead = [c for c in KEYS if c in df.columns]
    return df.select(*lead, "timestamp", *BAR_COLUMNS)
