"""Ordered work on groups of any size.

A plain window puts one key into one task. That is right where the rows per key have a
proven bound: a bar table holds one row per (key, slot), so hourly bars of a century are
below a million rows. Raw ticks, trial logs and bars at second cadence have no such bound
and one key may hold a third of the table. For those this module splits each key:

* ``bucket`` is any column that never decreases along the order (a time slice, a slice of
  a unique number). Its width bounds the rows of one (key, bucket) group. Where the rate of a
  key has no bound, ``Slices`` makes time slices as narrow as its busiest stretches need.
* ``running``     cumulative values, by two levels: summary per bucket, prefix over the
  summaries, local window plus carried value.
* ``ordinal``     exact row numbers, the same way.
* ``over_chunks`` any operator with a fixed lookback, on equal chunks of rows that bring
  the last rows of the chunk before along.
* ``exact_quantiles`` linear-interpolated quantiles: a sketch encloses the ranks, counts decide.

Shuffles go by (key, bucket), never by key alone; only the summaries do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.nulls import INF

_B = "__bucket"


def time_bucket(seconds: int, ts: str = "ts") -> Column:
    """Slice of the time axis; (key, ts) unique at a cadence c gives seconds/c rows at most."""
    return F.floor(F.unix_timestamp(F.col(ts)) / seconds)


def id_bucket(column: str, width: int = 65_536) -> Column:
    """Slice of a unique integer: at most ``width`` rows."""
    return F.floor(F.col(column) / width)


#: Steps in which a slice gets narrower, by four each time: down to 1 / 65536 of its width.
_STEPS = 8


@dataclass(frozen=True)
class Slices:
    """Slices of the time axis that hold at most ``rows`` rows of a key each, wherever its rows crowd.

    A slice is ``seconds`` wide. Slices with more rows are counted in finer cells, and each is cut into
    equal parts, of a quarter, a sixteenth, ... of its width, until none of them holds more. Rows of the same 1 / 65536 of
    a slice stay together. The counts are partial aggregates; only crowded slices get a row in what is joined back.
    """

    seconds: int
    rows: int = 500_000
    ts: str = "ts"

    def add(self, df: DataFrame, keys: Sequence[str], name: str = _B) -> DataFrame:
        """Add ``name``, the slice of each row, which grows along the time."""
        on, width, cells = [*keys, "__whole"], self.seconds * 1_000_000, 4**_STEPS
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        whole, cell = F.floor(us / F.lit(width)), F.floor(F.pmod(us, F.lit(width)) * F.lit(cells) / F.lit(width))
        d = df.withColumn("__whole", whole)
        slim = d.select(*on, cell.cast("int").alias("__cell"))
        crowded = slim.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > self.rows).drop("__n")
        counts = slim.join(crowded, on).groupBy(*on, "__cell").agg(F.count("*").alias("__n"))
        steps = F.explode(F.sequence(F.lit(1), F.lit(_STEPS))).alias("__step")
        parts = counts.select("*", steps).groupBy(*on, "__step", self._part(F.col("__cell"), F.col("__step")).alias("__part")).agg(F.sum("__n").alias("__n"))
        most = parts.groupBy(*on, "__step").agg(F.max("__n").alias("__n"))
        step = F.coalesce(F.min(F.when(F.col("__n") <= self.rows, F.col("__step"))), F.lit(_STEPS))
        d = d.join(most.groupBy(*on).agg(step.alias("__step")), on, "left")
        part = self._part(cell, F.coalesce("__step", F.lit(0)))
        return d.withColumn(name, (F.col("__whole") * F.lit(cells) + part).cast("bigint")).select(*df.columns, name)

    @staticmethod
    def _part(cell: Column, step: Column) -> Column:
        """First cell of the part that holds ``cell`` after so many steps."""
        size = F.pow(F.lit(4.0), F.lit(_STEPS) - step)
        return (F.floor(cell / size) * size).cast("bigint")


def _sliced(df: DataFrame, keys: Sequence[str], bucket: Column | Slices) -> DataFrame:
    return bucket.add(df, keys) if isinstance(bucket, Slices) else df.withColumn(_B, bucket)


_COMBINE = {
    "sum": lambda a, b: F.when(
        a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    ),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
    "first": lambda a, b: F.coalesce(a, b),
}


def _over(kind: str, x: Column, w) -> Column:
    return {
        "sum": lambda: F.sum(x).over(w),
        "count": lambda: F.count(x).over(w),
        "max": lambda: F.max(x).over(w),
        "min": lambda: F.min(x).over(w),
        "last": lambda: F.last(x, ignorenulls=True).over(w),
        "first": lambda: F.first(x, ignorenulls=True).over(w),
    }[kind]()


def _summary(kind: str, x: Column, order: Sequence[str]) -> Column:
    """Per-bucket summary; all of them combine on the map side."""
    at = F.struct(*[F.col(c) for c in order])
    return {
        "sum": lambda: F.sum(x),
        "count": lambda: F.count(x),
        "max": lambda: F.max(x),
        "min": lambda: F.min(x),
        "last": lambda: F.max_by(x, F.when(x.isNotNull(), at)),
        "first": lambda: F.min_by(x, F.when(x.isNotNull(), at)),
    }[kind]()


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exprs: dict[str, tuple],
    bucket: Column | Slices | None = None,
    before: bool = False,
) -> DataFrame:
    """Add cumulative values ``{name: (kind, expression)}`` along the order of each key.

    ``before``, or a third member of a tuple, leaves the current row out. Without ``bucket``
    this is a plain window. With one, the input is read twice: for the summaries (a few
    columns, combined on the map side) and for the rows. Before a second call on the result
    of a first, cut the lineage with ``session.written``.
    """
    end = {n: -1 if (e[2] if len(e) > 2 else before) else 0 for n, e in exprs.items()}

    def frame(by: list[str], name: str):
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, end[name])

    if bucket is None:
        return df.withColumns({n: _over(e[0], e[1], frame(list(keys), n)) for n, e in exprs.items()})
    d = _sliced(df, keys, bucket)
    by = [*keys, _B]
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    summary = d.groupBy(*by).agg(*[_summary(e[0], e[1], order).alias(f"__s_{n}") for n, e in exprs.items()])
    carry = summary.select(
        *by, *[_over("sum" if e[0] == "count" else e[0], F.col(f"__s_{n}"), across).alias(f"__c_{n}") for n, e in exprs.items()]
    )
    d = d.withColumns({f"__l_{n}": _over(e[0], e[1], frame(by, n)) for n, e in exprs.items()})
    d = d.join(carry, by, "left")
    d = d.withColumns({n: _COMBINE[e[0]](F.col(f"__c_{n}"), F.col(f"__l_{n}")) for n, e in exprs.items()})
    return d.drop(_B, *[f"__c_{n}" for n in exprs], *[f"__l_{n}" for n in exprs])


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | Slices | None, name: str = "rn"
) -> DataFrame:
    """Exact 1-based row number along the order of each key."""
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = running(df, keys, order, {name: ("count", F.lit(1))}, bucket)
    return out.withColumn(name, F.col(name).cast("bigint"))


def over_chunks(
    df: DataFrame,
    fn: Callable[[DataFrame, list[str]], DataFrame],
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column | Slices,
    lookback: int,
    chunk_rows: int = 200_000,
    lookahead: int = 0,
) -> DataFrame:
    """Run ``fn(df, keys)``, which adds columns from at most ``lookback`` earlier rows.

    Each key is cut into chunks of ``chunk_rows`` rows; a row is copied into every later
    chunk whose first rows look back at it. ``fn`` sees the chunk as one more key column.
    """
    d = ordinal(df, keys, order, bucket, "__rn").withColumn("__rn", F.col("__rn") - 1)
    home = F.floor(F.col("__rn") / chunk_rows)
    first = F.greatest(F.lit(0), F.floor((F.col("__rn") - lookahead) / chunk_rows))
    last = F.floor((F.col("__rn") + lookback) / chunk_rows)
    d = d.withColumn("__home", home).withColumn("__chunk", F.explode(F.sequence(first, last)))
    out = fn(d, [*keys, "__chunk"])
    return out.where("__chunk = __home").drop("__chunk", "__home", "__rn")


def value_slices(df: DataFrame, keys: Sequence[str], column: str, slices: int = 64, name: str = _B) -> DataFrame:
    """Add ``name``: slices of ``column`` within each key with about equal row counts, in order.

    The cut points come from a quantile sketch of each key, a partial aggregate inside the plan.
    """
    at = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = df.groupBy(*keys).agg(F.percentile_approx(column, at, F.lit(10 * slices)).alias("__cuts"))
    d = df.join(cuts, list(keys)) if keys else df.crossJoin(F.broadcast(cuts))  # one row
    return d.withColumn(name, F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c < F.col(column)))).drop("__cuts")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000, few_keys: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation for groups of any size: (keys, prob, quantile).

    A quantile sketch of each key, which is a partial aggregate of bounded size, gives two values that enclose the
    wanted ranks. Rows below are only counted; rows between, about a share of ``8 / accuracy`` of the
    group for each probability, are counted by value and the one or two at the ranks picked. Everything
    stays inside one plan. A sketch that misses its bounds raises an error instead of a wrong value.
    ``few_keys`` (thousands at most) broadcasts the sketches and counts, so that rows of a large key are not moved to one task.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = [min(max(p + s * 4 / accuracy, 0.0), 1.0) for s in (-1, 1) for p in probs]
    sketch = d.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy)).alias("__e"))
    m = len(probs)
    few = F.col("__n") <= accuracy  # the margin is less than a rank there, and all values are few enough
    end = lambda i, infinite: F.when(few, F.lit(infinite)).otherwise(F.col("__e")[i])
    wanted = F.array(*[F.struct(F.lit(p).alias("prob"), end(i, -INF).alias("lo"), end(m + i, INF).alias("hi")) for i, p in enumerate(probs)])
    sketch = sketch.where("__n > 0").select(*keys, "__n", wanted.alias("__w"))
    small = F.broadcast if few_keys else (lambda x: x)
    both = d.join(small(sketch), keys) if keys else d.crossJoin(F.broadcast(sketch))  # one row
    below = both.groupBy(*keys, "__n").agg(*[F.count(F.when(F.col("__v") < F.col("__w")[i]["lo"], 1)).alias(f"__b{i}") for i in range(m)])
    below = below.select(*keys, "__n", F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.col(f"__b{i}").alias("__below")) for i, p in enumerate(probs)])).alias("s")).select(*keys, "__n", "s.*")
    near = F.filter("__w", lambda w: (F.col("__v") >= w["lo"]) & (F.col("__v") <= w["hi"]))
    between = [(F.col("__v") >= F.col("__w")[i]["lo"]) & (F.col("__v") <= F.col("__w")[i]["hi"]) for i in range(m)]
    some = reduce(lambda a, b: a | b, between)  # compiled, unlike the filter of an array, which only the few rows left need
    inside = both.where(some).select(*keys, "__v", F.explode(near).alias("w")).groupBy(*keys, F.col("w.prob").alias("prob"), "__v").agg(F.count("*").alias("__m"))
    c = inside.join(small(below), [*keys, "prob"])
    c = c.withColumn("__hi", F.col("__below") + F.sum("__m").over(Window.partitionBy(*keys, "prob").orderBy("__v")))
    at = (F.col("__n") - 1) * F.col("prob")
    lo, up = F.floor(at), F.ceil(at)
    start = F.col("__hi") - F.col("__m")
    has = lambda rank: F.max(F.when((start <= rank) & (rank < F.col("__hi")), F.col("__v")))
    picked = c.groupBy(*keys, "prob").agg(has(lo).alias("__a"), has(up).alias("__z"), F.max(at - lo).alias("__f"))
    exact = F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise(F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__f"))
    return picked.select(*keys, "prob", F.coalesce(exact, F.raise_error(F.lit("a quantile lies outside the bounds of its sketch")).cast("double")).alias("quantile"))
