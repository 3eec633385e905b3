"""Time alignment, timeframe joins and small-table joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import Slices, ordinal, running

KEYS = ("series_key",)
_SHARED_SLICE = 30 * 86_400


def _tagged_union(left: DataFrame, sources: dict[str, tuple[DataFrame, list[str]]], keys: Sequence[str]) -> DataFrame:
    """Left and source rows in one relation: side 0 sorts before side 1 at equal times."""
    blank = {n: F.lit(None).cast(_struct_type(df, cols)) for n, (df, cols) in sources.items()}
    body = F.struct(*[F.col(c) for c in left.columns if c not in keys and c != "ts"])
    rows = left.select(*keys, "ts", F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__tie"), body.alias("__left"),
                       *[x.alias(f"__{n}") for n, x in blank.items()])
    left_type = rows.schema["__left"].dataType
    for n, (df, cols) in sources.items():
        tie = F.col("seq").cast("bigint") if "seq" in df.columns else F.lit(None).cast("bigint")
        rows = rows.unionByName(
            df.select(*keys, "ts", F.lit(0).alias("__side"), tie.alias("__tie"), F.lit(None).cast(left_type).alias("__left"),
                      *[(F.struct(*cols) if m == n else blank[m]).alias(f"__{m}") for m in sources])
        )
    return rows


def _struct_type(df: DataFrame, cols: Sequence[str]):
    return df.select(F.struct(*cols).alias("s")).schema["s"].dataType


def _names(left: DataFrame, name: str, cols: Sequence[str], taken: set[str]) -> dict[str, str]:
    """Output names: a suffix only where a column would collide."""
    out = {c: (f"{c}_{name}" if c in taken else c) for c in cols}
    taken.update(out.values())
    return out


def align_sources(
    left: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str] = KEYS, bucket: Column | Slices | None = None
) -> DataFrame:
    """As-of join of any number of sources: for each left row the latest source row at or
    before its time (of several at the same time, the last by ``seq``).

    Sources that have the key columns are merged in one union pass: one shuffle for all.
    Sources without keys are aligned with the distinct left times and joined on the time.
    A NULL field of a matched source row stays NULL. ``bucket`` (slices of ``ts``) splits
    series of unbounded length; sources without keys are one series and always sliced.
    """
    taken, renames = set(left.columns), {}
    keyed, shared = {}, {}
    for n, df in sources.items():
        is_keyed = all(k in df.columns for k in keys)
        cols = [c for c in df.columns if c not in keys and c not in ("ts", "seq")]
        renames[n] = _names(left, n, cols, taken)
        (keyed if is_keyed else shared)[n] = (df, cols)

    def last_rows(rows: DataFrame, names, ks, cut) -> DataFrame:
        return running(rows, ks, ["ts", "__side", "__tie"], {f"__l_{n}": ("last", F.col(f"__{n}")) for n in names}, cut)

    def unpack(names) -> list[Column]:
        return [F.col(f"__l_{n}")[c].alias(renames[n][c]) for n in names for c in renames[n]]

    out = left
    if keyed:
        rows = last_rows(_tagged_union(left, keyed, list(keys)), keyed, keys, bucket).where("__side = 1")
        own = [F.col("__left")[c].alias(c) for c in left.columns if c not in keys and c != "ts"]
        out = rows.select(*keys, "ts", *own, *unpack(keyed))
    if shared:
        times = left.select("ts").distinct()
        rows = last_rows(_tagged_union(times.withColumn("__t", F.lit(1)), shared, []), shared, [], bucket if bucket is not None else Slices(_SHARED_SLICE)).where("__side = 1")
        out = out.join(rows.select("ts", *unpack(shared)), "ts", "left")
    return out


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, name: str = "right", bucket: Column | Slices | None = None) -> DataFrame:
    return align_sources(left, {name: right}, keys, bucket)


def time_spine(bounds: DataFrame, step: str) -> DataFrame:
    """One row per step between ``start`` and ``end`` of a one-row-per-key bounds table."""
    others = [c for c in bounds.columns if c not in ("start", "end")]
    return bounds.select(*others, F.explode(F.sequence("start", "end", F.expr(f"INTERVAL {step}"))).alias("ts"))


def timeframe_join(frames: dict[str, DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner join of several timeframes on (key, ts), value columns suffixed by timeframe."""
    on = [*keys, "ts"]
    renamed = [df.select(*on, *[F.col(c).alias(f"{c}_{tf}") for c in df.columns if c not in on]) for tf, df in frames.items()]
    return reduce(lambda a, b: a.join(b, on, "inner"), renamed)


def positional_zip(frames: dict[str, DataFrame], keys: Sequence[str] = KEYS, order=("ts",), buckets: dict[str, Column] | None = None) -> DataFrame:
    """Rows of several tables side by side by position; stops with the shortest."""
    parts = []
    for n, df in frames.items():
        d = ordinal(df, keys, order, (buckets or {}).get(n), "pos")
        parts.append(d.select(*keys, "pos", *[F.col(c).alias(f"{c}_{n}") for c in df.columns if c not in keys]))
    return reduce(lambda a, b: a.join(b, [*keys, "pos"], "inner"), parts)


def membership_mask(df: DataFrame, members: DataFrame, on: Sequence[str], name: str = "is_member") -> DataFrame:
    """1 where the key occurs in ``members``, else 0."""
    m = members.select(*on).distinct().withColumn(name, F.lit(1))
    return df.join(m, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def param_grid(spark, **lists) -> DataFrame:
    """Every combination of the given parameter lists: one row, exploded per list."""
    d = spark.range(1).drop("id")
    for n, values in lists.items():
        d = d.withColumn(n, F.explode(F.array(*[F.lit(v) for v in values])))
    return d


def rows_in_ranges(df: DataFrame, ranges: DataFrame, position: str, keys: Sequence[str] = KEYS, width: int = 256) -> DataFrame:
    """Rows joined to every range [lo, hi) of their series that holds their position.

    Both sides are cut into position slices of ``width`` rows and joined on (key, slice), so
    a row meets only ranges that reach its slice, and a hot series spreads over its slices.
    Ranges overlap (rolling windows), so a row may occur once per range.
    """
    cut = ranges.withColumn("__slice", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    d = df.withColumn("__slice", F.floor(F.col(position) / width)).join(cut, [*keys, "__slice"], "inner")
    return d.where((F.col(position) >= F.col("lo")) & (F.col(position) < F.col("hi"))).drop("__slice")
