"""Projection, de-duplication, filling, capping and repair of bar tables.

Ordered fills use one window per series (bar tables, see ``ordered``); pass ``bucket`` where
a series has no row bound. Copies collapse in partial aggregates before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.nulls import ratio
from tideline.functions.rolling import from_end, series_window, so_far
from tideline.operators.bars import PRICES
from tideline.operators.ordered import running
from tideline.session import written

KEYS = ("series_key",)
TIME_COLUMNS = ("ts", "timestamp", "datetime", "date")


def select_mode(df: DataFrame, mode: str, target: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """S keeps the target; M and MS keep every column that is not time."""
    lead = [k for k in keys if k in df.columns]
    if mode == "S":
        return df.select(*lead, target)
    if mode not in ("M", "MS"):
        raise ValueError(f"unknown mode {mode!r}")
    return df.select(*lead, *[c for c in df.columns if c not in lead and c not in TIME_COLUMNS])


def filter_selected(df: DataFrame, selected: Sequence[str], essential=("ts", "open", "high", "low", "close", "volume"),
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys, essential columns and those of the selected features the table has."""
    wanted = [*keys, *essential, *[c for c in selected if c not in essential]]
    return df.select(*[c for c in wanted if c in df.columns])


def normalise_columns(df: DataFrame) -> DataFrame:
    """Trim and lower the names; the first date or time column becomes ``ts``.

    Numbers are Unix seconds, text is parsed as ISO time (unparsable becomes NULL).
    """
    d = df.toDF(*[c.strip().lower() for c in df.columns])
    name = next((c for c in d.columns if "date" in c or "time" in c), None)
    if name is None:
        raise ValueError("no date or time column")
    kind = d.schema[name].dataType
    if isinstance(kind, T.NumericType):
        ts = F.timestamp_seconds(F.col(name))
    elif isinstance(kind, T.StringType):
        ts = F.coalesce(
            F.timestamp_seconds(F.expr(f"try_cast(`{name}` AS DOUBLE)")), F.expr(f"try_cast(`{name}` AS TIMESTAMP)")
        )
    else:
        ts = F.col(name).cast("timestamp")
    return d.select(ts.alias("ts"), *[c for c in d.columns if c != name])


def clean_nonnumeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose named columns are all numbers, as DOUBLE."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns}).na.drop(subset=list(columns))


def dedup_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()


def dedup_timestamp(df: DataFrame, values: Sequence[str], seq: str = "seq", keys: Sequence[str] = KEYS) -> DataFrame:
    """First row per (key, ts) in order of ``seq``, as a hash aggregate."""
    return df.groupBy(*keys, "ts").agg(*[F.min_by(v, seq).alias(v) for v in values], F.min(seq).alias(seq))


def ffill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, order=("ts",), bucket: Column | None = None) -> DataFrame:
    filled = running(df, keys, order, {f"__f_{c}": ("last", F.col(c)) for c in columns}, bucket)
    return filled.withColumns({c: F.col(f"__f_{c}") for c in columns}).drop(*[f"__f_{c}" for c in columns])


def bfill(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, order=("ts",)) -> DataFrame:
    """Fill from later rows: looks into the future, so never use it on forecast inputs."""
    w = from_end(keys, order)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def interpolate_linear(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, order=("ts",)) -> DataFrame:
    """Linear between neighbours by row position; a trailing gap takes the last value."""
    w = series_window(keys, order)
    d = df.withColumn("__i", F.row_number().over(w))
    look_back, look_ahead = so_far(w), from_end(keys, order)
    out = {}
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("__i"))
        x0, i0 = F.last(c, ignorenulls=True).over(look_back), F.last(at, ignorenulls=True).over(look_back)
        x1, i1 = F.last(c, ignorenulls=True).over(look_ahead), F.last(at, ignorenulls=True).over(look_ahead)
        blend = x0 + (x1 - x0) * ratio((F.col("__i") - i0).cast("double"), (i1 - i0).cast("double"))
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(x0.isNotNull(), F.coalesce(blend, x0))
    return d.withColumns(out).drop("__i")


def fill_median(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Remaining NULLs become the exact median of the series (bars: bounded rows per key)."""
    whole = Window.partitionBy(*keys)  # a join with the medians would make the rows twice
    return df.withColumns({c: F.coalesce(c, F.percentile(c, F.lit(0.5)).over(whole)) for c in columns})


def fill_mode(df: DataFrame, column: str, keys: Sequence[str], default: str = "unknown") -> DataFrame:
    """Remaining NULLs become the most frequent value of the key, the smallest one on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), F.asc(column)))
    modes = counts.withColumn("__r", best).where("__r = 1").select(*keys, F.col(column).alias("__mode"))
    d = df.join(modes, list(keys), "left")
    return d.withColumn(column, F.coalesce(column, "__mode", F.lit(default))).drop("__mode")


def impute_knn(df: DataFrame, target: str, features: Sequence[str], k: int = 5, keys: Sequence[str] = KEYS, order=("ts",)) -> DataFrame:
    """Missing ``target`` becomes the mean of the k nearest rows of the whole series that have one.

    Distance over the features both rows have, scaled up for missing ones; equal distances go by
    order. Exact, by ``nearest``. Rows without a donor stay NULL.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = written(df.withColumn("__i", F.row_number().over(series_window(keys, order))), "knn")
    base = rows.select(*keys, "__i", F.col(target).cast("double").alias("__y"), x.alias("__x"))
    found = nearest(base, k, len(features), keys).groupBy(*keys, "__i").agg(F.avg("y").alias("__mean"))
    return rows.join(found, [*keys, "__i"], "left").withColumn(target, F.coalesce(F.col(target), F.col("__mean"))).drop("__mean", "__i")


#: Donors around a row that bound how far its nearest ones can be, rows that look for them at once, and pairs that are measured at once.
AROUND, LOOKERS, PAIRS = 64, 4096, 1 << 20


def nearest(base: DataFrame, k: int, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, __i, far, i, y): the k nearest donors of every row without a value, among all rows of its series.

    ``base`` has (keys, __i, __y, __x) with ``n`` features in __x, and each series is one group of bounded rows (bars). Its donors are
    sorted by one feature. The k-th distance to the AROUND donors next to a row there is a bound; a donor whose one feature is
    farther off than that can't be nearer, so only those within are measured. Exact, with equal distances by __i. Rows without a key have no series.
    """
    keys = list(keys)
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    mine = base.where(named).select(*keys, F.col("__i").cast("bigint").alias("__i"), F.col("__y").cast("double").alias("__y"), *[F.col("__x")[j].cast("double").alias(f"__x{j}") for j in range(n)])
    schema = T.StructType([*[T.StructField(c, base.schema[c].dataType) for c in keys], *[T.StructField(c, t) for c, t in (("__i", T.LongType()), ("far", T.DoubleType()), ("i", T.LongType()), ("y", T.DoubleType()))]])

    def search(table: pa.Table) -> pa.Table:
        i, blank = table["__i"].to_numpy(), table["__y"].is_null().to_numpy()
        y = table["__y"].fill_null(0.0).to_numpy()
        x = np.column_stack([table[f"__x{j}"].fill_null(0.0).to_numpy() for j in range(n)])
        mask = sum((table[f"__x{j}"].is_valid().to_numpy().astype(np.int64) << j) for j in range(n))
        row, far, donor = _nearest_rows(x, mask, blank, i, k)
        own = {c: table[c].take(pa.array(row)) for c in keys}
        return pa.table([*own.values(), pa.array(i[row], pa.int64()), pa.array(far, pa.float64()), pa.array(i[donor], pa.int64()), pa.array(y[donor], pa.float64())], names=schema.names)

    return mine.groupBy(*keys).applyInArrow(search, schema)


def _nearest_rows(x: np.ndarray, mask: np.ndarray, blank: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance, donor) of the ``k`` nearest donors of all ``blank`` rows of one series; ``mask`` has a bit for each feature that a row has."""
    width, out = x.shape[1], []
    kinds = {int(m): np.flatnonzero(~blank & (mask == m)) for m in np.unique(mask[~blank])}
    for own in np.unique(mask[blank]):
        grids = [_Line(x, donors, [j for j in range(width) if (int(own) & m) >> j & 1], width) for m, donors in kinds.items() if int(own) & m]
        looking = np.flatnonzero(blank & (mask == own))
        for low in range(0, len(looking) if grids else 0, LOOKERS):
            rows = looking[low : low + LOOKERS]
            around = np.concatenate([g.around(x[rows]) for g in grids], axis=1)
            bound = np.partition(around, k - 1, axis=1)[:, k - 1] if around.shape[1] >= k else np.full(len(rows), np.inf)
            bound = np.where(np.isfinite(bound), bound, np.inf)
            spans = [g.span(x[rows], bound) for g in grids]
            ends = np.cumsum(sum(high - first for first, high in spans))
            a = 0
            while a < len(rows):  # rows whose donors within the bound are about PAIRS, one row at least
                z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
                found = [g.within(x[rows[a:z]], first[a:z], high[a:z], bound[a:z]) for g, (first, high) in zip(grids, spans, strict=True)]
                of, far, donor = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((i[donor], far, of))
                of, far, donor = of[order], far[order], donor[order]
                starts = np.searchsorted(of, np.arange(z - a))
                best = np.arange(len(of)) - starts[of] < k
                out.append((rows[a:z][of[best]], far[best], donor[best]))
                a = z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))


class _Line:
    """Donors with the same features, sorted by that of the ``shared`` ones in which they differ most."""

    def __init__(self, x: np.ndarray, donors: np.ndarray, shared: list[int], width: int):
        self.shared, self.scale = shared, float(width)
        with np.errstate(all="ignore"):
            spread = np.nan_to_num(x[donors][:, shared].std(axis=0), nan=0.0, posinf=0.0)
        self.by = shared[int(np.argmax(spread))]
        self.donors = donors[np.argsort(x[donors, self.by], kind="stable")]
        self.at = x[self.donors]
        self.line = np.ascontiguousarray(self.at[:, self.by])

    def _far(self, x: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Distances between rows ``x`` and the donors at ``places``, which has a row or a number for each of them."""
        total = 0.0
        with np.errstate(all="ignore"):
            for j in self.shared:
                gap = (x[:, j, None] if places.ndim == 2 else x[:, j]) - self.at[places, j]
                total = total + gap * gap
            return np.sqrt(total * self.scale / len(self.shared))

    def around(self, x: np.ndarray) -> np.ndarray:
        """Distances to the AROUND donors, or all where they are fewer, next to each row of ``x`` on the line."""
        n = min(AROUND, len(self.line))
        first = np.clip(np.searchsorted(self.line, x[:, self.by]) - n // 2, 0, len(self.line) - n)
        return self._far(x, first[:, None] + np.arange(n))

    def span(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the donors on the line that may be as near as ``bound``."""
        v, reach = x[:, self.by], bound * np.sqrt(len(self.shared) / self.scale) * (1 + 1e-9)
        all_ = ~np.isfinite(v) | ~np.isfinite(reach)
        v, reach = np.where(all_, 0.0, v), np.where(all_, 0.0, reach)
        first, last = np.searchsorted(self.line, v - reach), np.searchsorted(self.line, v + reach, side="right")
        return np.where(all_, 0, first), np.where(all_, len(self.line), last)

    def within(self, x: np.ndarray, first: np.ndarray, last: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the row in ``x``, distance, donor) of all donors of each span that are within the bound."""
        n = last - first
        of = np.repeat(np.arange(len(x)), n)
        places = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
        far = self._far(x[of], places)
        near = ~(far > bound[of]) & (np.isfinite(far) | ~np.isfinite(bound[of]))
        return of[near], far[near], self.donors[places[near]]


def impute_chain(df: DataFrame, external: Sequence[str] = (), keys: Sequence[str] = KEYS, order=("ts",)) -> DataFrame:
    """Prices forward, external columns by neighbours, then backward, linear, median."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    prices = [c for c in PRICES if c in numeric]
    d = ffill(df, prices, keys, order)
    for c in external:
        d = impute_knn(d, c, [f for f in external if f != c] or prices, keys=keys, order=order)
    d = bfill(d, numeric, keys, order)
    d = interpolate_linear(d, numeric, keys, order)
    return fill_median(d, numeric, keys)


def cap_jump(df: DataFrame, columns: Sequence[str] = PRICES, limit: float = 0.5, mode: str = "by_sign",
             keys: Sequence[str] = KEYS, order=("ts",)) -> DataFrame:
    """Values more than ``limit`` away from the value before move to the limit.

    ``mode="reference"`` lifts drops to (1 + limit) times the value before as well. All
    comparisons use the original values, so one cap never causes the next.
    """
    w = series_window(keys, order)
    out = {}
    for c in columns:
        before = F.lag(c).over(w)
        move = ratio(F.col(c), before) - 1
        low = before * (1 + limit) if mode == "reference" else before * (1 - limit)
        out[c] = F.when(move > limit, before * (1 + limit)).when(move < -limit, low).otherwise(F.col(c))
    return df.withColumns(out)


def clip_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("volume", F.when(F.col("volume").isNotNull(), F.greatest(F.col("volume"), F.lit(0.0))))


def enforce_ohlc(df: DataFrame) -> DataFrame:
    """High is the largest of high, open, close; low the smallest; NULLs do not count."""
    return df.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})


def clean_bars(df: DataFrame, mode: str = "by_sign", keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact copies out, gaps filled both ways, jumps capped, volume and OHLC order repaired."""
    values = [*PRICES, "volume"]
    d = df.select(*keys, "ts", *values).dropDuplicates()
    d = bfill(ffill(d, values, keys), values, keys)
    return enforce_ohlc(clip_volume(cap_jump(d, PRICES, 0.5, mode, keys)))


def winsorise(df: DataFrame, columns: Sequence[str], flagged: Column, keys: Sequence[str] = KEYS, lo=0.05, hi=0.95) -> DataFrame:
    """Flagged rows only: limit each column to its exact quantiles within the series."""
    whole = Window.partitionBy(*keys)  # bars: bounded rows per key; a join with the quantiles would make the rows twice
    d = df.withColumn("__flag", flagged).withColumns({f"__q_{c}": F.percentile(c, F.array(F.lit(lo), F.lit(hi))).over(whole) for c in columns})
    out = {
        c: F.when(F.col("__flag") & F.col(c).isNotNull(),
                  F.least(F.greatest(F.col(c), F.col(f"__q_{c}")[0]), F.col(f"__q_{c}")[1])).otherwise(F.col(c))
        for c in columns
    }
    return d.withColumns(out).drop("__flag", *[f"__q_{c}" for c in columns])


def row_quality(df: DataFrame, as_of: str, values: Sequence[str] = (*PRICES, "volume")) -> DataFrame:
    """Age in hours at ``as_of``, share of missing values and a score per row."""
    missing = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in values)
    consistent = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    d = df.withColumns(
        {
            "data_age_hours": (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("ts")) / 3600,
            "missing_data_ratio": missing / F.lit(float(len(values))),
        }
    )
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    score = (one(F.col("missing_data_ratio") == 0) + one(F.col("volume") > 0) + one(consistent)) / 3
    return d.withColumn("data_quality_score", score)


def enhance(df: DataFrame, as_of: str, external: Sequence[str] = (), flagged: Column | None = None, keys: Sequence[str] = KEYS, order=("ts", "seq")) -> DataFrame:
    """Whole repair of bars: fill gaps, limit outliers, make rows consistent, one row per time, quality columns.

    External columns are filled from neighbouring rows. ``flagged`` names the outliers; without it an
    isolation forest over prices and volume does.
    """
    from tideline.operators.isolation import isolation_flag

    values = [*PRICES, "volume"]
    d = impute_chain(df, external, keys, order)
    if flagged is None:
        d = isolation_flag(d, values, [*keys, *order]).drop("anomaly_score")
        flagged = F.col("is_outlier") == 1
    d = winsorise(d, values, flagged, keys).drop("is_outlier")
    d = dedup_timestamp(enforce_ohlc(clip_volume(d)), [*values, *external], keys=keys)
    return row_quality(d, as_of)


def common_time_range(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows between the latest common start and the earliest common end of all tables."""
    bounds = None
    for df in tables.values():
        b = df.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
        bounds = b if bounds is None else bounds.unionByName(b)
    common = bounds.agg(F.max("a").alias("__from"), F.min("z").alias("__to"))  # one row
    return {
        n: df.join(F.broadcast(common), (F.col("ts") >= F.col("__from")) & (F.col("ts") <= F.col("__to"))).drop("__from", "__to")
        for n, df in tables.items()
    }


def keyword_filter(df: DataFrame, columns: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Rows where any of the columns contains any keyword, ignoring case."""
    hit = F.lit(False)
    for c in columns:
        for k in keywords:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(k.lower()), F.lit(False))
    return df.where(hit)
