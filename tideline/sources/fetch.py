"""Sources that are fetched by time range, and datasets by name.

A ``Source`` has one method, ``fetch(spark, start, end)``: its rows with ``ts`` from ``start`` up to,
but not including, ``end``. Two kinds are given; any object with that method is a source as well.

* ``TableSource``: files that Spark reads itself. The range becomes a filter of the scan on the file's own time
  column, so row groups outside are skipped.
* ``SlicedSource``: anything that a function ``fetch_data(start, end)`` returns, such as a web service or another
  library's files. The time axis is cut into slices of ``step``; a slice is a partition, fetched by
  one call on an executor and fetched again alone if its executor is lost. Comparisons of ``ts`` with
  constants are pushed into the source, so slices outside are never called.

``Datasets`` maps names to preparations of sources (a preparation takes ``(spark, start, end)`` and further arguments by
name), so a job names its data in its settings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tideline.session import prepare

TICK = timedelta(microseconds=1)


class Source(Protocol):
    def fetch(self, spark: SparkSession, start: datetime, end: datetime) -> DataFrame: ...


def utc(moment: datetime) -> datetime:
    """The same moment with its zone; times without one are UTC."""
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def within(df: DataFrame, start: datetime, end: datetime, column: str = "ts") -> DataFrame:
    """Rows from ``start`` up to ``end``; constants of the column's own type, so that the filter reaches the scan."""
    kind = df.schema[column].dataType
    a, b = (F.lit(utc(t).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end))
    if isinstance(kind, T.DateType):
        # a date stands for its midnight: the first one in the range is that of ``start``, or the day after
        a, b = (F.to_date(t + F.expr("INTERVAL '86399.999999' SECOND")) for t in (a, b))
    elif not isinstance(kind, T.TimestampNTZType):
        a, b = a.cast(kind), b.cast(kind)
    return df.where((F.col(column) >= a) & (F.col(column) < b))


@dataclass(frozen=True)
class TableSource:
    """Files with a time column; ``columns`` maps output names to expressions (all columns if empty)."""

    path: str
    time: str
    columns: tuple[tuple[str, str], ...] = ()
    fmt: str = "parquet"

    def fetch(self, spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
        rows = within(prepare(spark).read.format(self.fmt).load(self.path), start, end, self.time)
        others = [F.expr(e).alias(n) for n, e in self.columns] or [c for c in rows.columns if c not in (self.time, "ts")]
        return rows.select(F.col(self.time).cast("timestamp").alias("ts"), *others)


@dataclass
class Slice(InputPartition):
    start: datetime
    end: datetime


class _Slices(DataSourceReader):
    """Slices between ``first`` and ``last`` that the pushed comparisons of ``ts`` leave."""

    def __init__(self, fetch_data, first: datetime, last: datetime, step: timedelta):
        self.fetch_data, self.first, self.last, self.step = fetch_data, first, last, step
        self.start, self.end = first, last

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("ts",) and isinstance(value, datetime):
                value = utc(value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.start = max(self.start, value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.end = min(self.end, value if isinstance(f, LessThan) else value + TICK)
            yield f  # slices are coarser than the range: Spark filters their rows

    def partitions(self) -> Sequence[InputPartition]:
        out, n = [], max(0, (self.start - self.first) // self.step)
        while (a := self.first + n * self.step) < self.end:
            out.append(Slice(a, min(a + self.step, self.last)))
            n += 1
        return out

    def read(self, partition: Slice | None) -> Iterator:
        if partition is not None:  # Spark asks once without a slice where none is left
            yield from self.fetch_data(partition.start, partition.end)


@dataclass(frozen=True)
class SlicedSource:
    """Rows of ``fetch_data(start, end)``: tuples or Arrow record batches of ``schema``, which has ``ts TIMESTAMP``.

    ``first`` and ``last`` bound the time axis, as the source knows its own range. The function runs on the executors, so
    it has to be picklable; it may be called again for a slice and has to give the same rows then.
    """

    name: str
    schema: str
    fetch_data: Callable[[datetime, datetime], Iterable]
    first: datetime
    last: datetime
    step: timedelta = timedelta(days=1)

    def register(self, spark: SparkSession) -> None:
        """Make the source readable as ``spark.read.format(name)``."""
        source, reader = self, _Slices(self.fetch_data, utc(self.first), utc(self.last), self.step)

        class Fetched(DataSource):
            @classmethod
            def name(cls):
                return source.name

            def schema(self):
                return source.schema

            def reader(self, schema):
                return reader

        spark.dataSource.register(Fetched)

    def fetch(self, spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
        prepare(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
        self.register(spark)
        return within(spark.read.format(self.name).load(), start, end)


Preparation = Callable[..., DataFrame]


class Datasets:
    """Names of datasets with what prepares them: ``(spark, start, end, **settings) -> DataFrame``."""

    def __init__(self):
        self._by_name: dict[str, Preparation] = {}

    def register(self, name: str) -> Callable[[Preparation], Preparation]:
        def add(prepare_: Preparation) -> Preparation:
            if name in self._by_name:
                raise ValueError(f"dataset {name} registered twice")
            self._by_name[name] = prepare_
            return prepare_

        return add

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def load(self, spark: SparkSession, name: str, start: datetime, end: datetime, **settings) -> DataFrame:
        if name not in self._by_name:
            raise KeyError(f"no dataset {name}: one of {', '.join(self.names())}")
        return self._by_name[name](spark, start, end, **settings)


def aligned(spark: SparkSession, left: DataFrame, sources: dict[str, Source], start: datetime, end: datetime, history: timedelta = timedelta(0)) -> DataFrame:
    """Rows of ``left`` in the range with the latest row at or before them of every source, which is read from ``history`` earlier on."""
    from tideline.operators.joins import align_sources

    fetched = {n: s.fetch(spark, start - history, end) for n, s in sources.items()}
    return align_sources(within(left, start, end), fetched)
