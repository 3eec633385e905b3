"""Splits, folds, scaling, windows and time encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.nulls import text_hash
from tideline.functions.rolling import series_window
from tideline.operators.ordered import ordinal

KEYS = ("series_key",)


def tail_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Last n rows of every series; Spark keeps only n rows per key on the map side."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).where(f"__k <= {n}").drop("__k")


def positioned(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), bucket: Column | None = None) -> DataFrame:
    """Add the 0-based position ``rn`` and the length ``n`` of the series."""
    d = ordinal(df, keys, order, bucket, "rn").withColumn("rn", F.col("rn").cast("bigint") - 1)
    return d.join(series_lengths(df, keys), list(keys))


def series_lengths(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _by_role(df: DataFrame, borders: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per role whose [from, to) holds the position: overlapping roles repeat rows."""
    roles = F.array(*[F.when((F.col("rn") >= a) & (F.col("rn") < z), r) for r, (a, z) in borders.items()])
    return df.withColumn("role", F.explode(F.filter(roles, lambda r: r.isNotNull())))


def split_ratio(df: DataFrame, seq_len: int, train=0.7, test=0.2, percent: int = 100) -> DataFrame:
    """Train, validation and test in time order; the later two start ``seq_len`` rows earlier."""
    n = F.col("n")
    n_train, n_test = F.floor(n * train), F.floor(n * test)
    train_end = F.floor((n_train - seq_len) * percent / 100) + seq_len
    return _by_role(
        df, {"train": (F.lit(0), train_end), "val": (n_train - seq_len, n - n_test), "test": (n - n_test - seq_len, n)}
    )


def split_months(df: DataFrame, seq_len: int, rows_per_day: int = 24, months=(12, 4, 4)) -> DataFrame:
    """Fixed months of 30 days; ``rows_per_day`` is 24 for hourly, 96 for quarter-hourly data."""
    a, b, c = (m * 30 * rows_per_day for m in months)
    return _by_role(
        df, {"train": (F.lit(0), F.lit(a)), "val": (F.lit(a - seq_len), F.lit(a + b)), "test": (F.lit(a + b - seq_len), F.lit(a + b + c))}
    )


def split_tail(df: DataFrame, train_rows: int, pred_len: int, seq_len: int = 0) -> DataFrame:
    """First ``train_rows`` rows to train on, the last ``pred_len`` (+ ``seq_len``) to test on."""
    n = F.col("n")
    return _by_role(df, {"train": (F.lit(0), F.lit(train_rows)), "test": (n - pred_len - seq_len, n)})


# --- scaling -----------------------------------------------------------------------------

def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "standard", keys: Sequence[str] = KEYS) -> DataFrame:
    """Centre and scale per series and column, from the training rows only. Zero scale is 1."""
    aggs = []
    for c in columns:
        if kind == "standard":
            centre, scale = F.avg(c), F.stddev_pop(c)
        elif kind == "robust":
            q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            centre, scale = q[1], q[2] - q[0]
        else:
            raise ValueError(f"unknown scaler {kind!r}")
        aggs += [centre.alias(f"__centre_{c}"), F.when(scale != 0, scale).otherwise(1.0).alias(f"__scale_{c}")]
    return train.groupBy(*keys).agg(*aggs)


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, inverse: bool = False) -> DataFrame:
    d = df.join(scaler, list(keys))
    out = {
        c: F.col(c) * F.col(f"__scale_{c}") + F.col(f"__centre_{c}") if inverse else (F.col(c) - F.col(f"__centre_{c}")) / F.col(f"__scale_{c}")
        for c in columns
    }
    return d.withColumns(out).drop(*[f"__{s}_{c}" for s in ("centre", "scale") for c in columns])


# --- windows and arrays ------------------------------------------------------------------

def sliding_windows(df: DataFrame, features: Sequence[str], seq_len: int, label_len: int, pred_len: int,
                    keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """One sample per start position and feature: ``seq_x`` and ``seq_y`` that overlaps it by ``label_len``."""
    lead = [*keys, order]
    w = series_window(keys, [order])
    frames = {}
    for f in features:
        frames[f"x_{f}"] = F.collect_list(f).over(w.rowsBetween(0, seq_len - 1))
        frames[f"y_{f}"] = F.collect_list(f).over(w.rowsBetween(seq_len - label_len, seq_len + pred_len - 1))
    d = df.withColumns(frames).where(F.size(f"y_{features[0]}") == label_len + pred_len)
    samples = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x_{f}").alias("seq_x"), F.col(f"y_{f}").alias("seq_y")) for f in features])
    return d.select(*lead, F.explode(samples).alias("s")).select(*lead, "s.*")


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def instance_norm(df: DataFrame, column: str, eps: float = 1e-5, subtract_last: bool = False) -> DataFrame:
    """Normalise each array by its own centre and spread, which stay as ``centre`` and ``spread``."""
    a = F.col(column)
    mean = array_sum(a) / F.size(a)
    d = df.withColumn("__mean", mean)
    var = array_sum(F.transform(a, lambda x: (x - F.col("__mean")) * (x - F.col("__mean")))) / F.size(a)
    d = d.withColumns({"centre": F.element_at(a, -1) if subtract_last else F.col("__mean"), "spread": F.sqrt(var + eps)})
    return d.withColumn(column, F.transform(a, lambda x: (x - F.col("centre")) / F.col("spread"))).drop("__mean")


def instance_denorm(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.transform(column, lambda x: x * F.col("spread") + F.col("centre")))


def patches(a: Column, length: int, stride: int) -> Column:
    """Overlapping slices of an array whose last value is repeated ``stride`` times."""
    padded = F.concat(a, F.array_repeat(F.element_at(a, -1), stride))
    last = F.size(a) + stride - length
    return F.transform(F.sequence(F.lit(0), F.floor(last / stride).cast("int")), lambda i: F.slice(padded, i * stride + 1, length))


def series_decompose(df: DataFrame, column: str, kernels: Sequence[int] = (25,), keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Trend (centred moving mean, edges repeated) and the rest, averaged over the kernels."""
    w = series_window(keys, [order])
    ends = df.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min_by(column, order).alias("__first"), F.max_by(column, order).alias("__last")
    )
    d = df.withColumn("__i", F.row_number().over(w) - 1)
    d = d.withColumns({f"__s{k}": F.sum(column).over(w.rowsBetween(-(k - 1) // 2, (k - 1) // 2)) for k in kernels})
    d = d.join(ends, list(keys))
    trend = F.lit(0.0)
    for k in kernels:
        h = (k - 1) // 2
        left = F.greatest(F.lit(0), F.lit(h) - F.col("__i"))
        right = F.greatest(F.lit(0), F.lit(h) - (F.col("__n") - 1 - F.col("__i")))
        trend = trend + (F.col(f"__s{k}") + left * F.col("__first") + right * F.col("__last")) / k
    d = d.withColumn("trend", trend / len(kernels))
    return d.withColumn("seasonal", F.col(column) - F.col("trend")).drop("__n", "__i", "__first", "__last", *[f"__s{k}" for k in kernels])


def _pad_left(a: Column, n: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(a)), a)


def _pad_right(a: Column, n: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(a)))


def last_insample_window(panel: DataFrame, values: str, seq_len: int) -> DataFrame:
    """Last ``seq_len`` values of each array, zeros and mask 0 on the left of short ones."""
    a = F.slice(F.col(values), F.greatest(F.lit(1), F.size(values) - seq_len + 1), F.lit(seq_len))
    mask = F.transform(a, lambda x: F.lit(1.0))
    return panel.withColumns({"insample": _pad_left(a, seq_len), "insample_mask": _pad_left(mask, seq_len)})


def panel_window_sample(panel: DataFrame, key: str, values: str, seq_len: int, label_len: int, pred_len: int, limit: int, seed: int = 0) -> DataFrame:
    """A seeded random cut per series with padded windows before and after it and their masks."""
    a, n = F.col(values), F.size(values)
    low = F.greatest(F.lit(1), n - limit)
    cut = low + (text_hash(F.lit(seed), F.col(key)) % F.greatest(n - low, F.lit(1))).cast("int")
    d = panel.withColumn("cut", cut)
    c = F.col("cut")
    start, first = F.greatest(F.lit(0), c - seq_len), F.greatest(F.lit(0), c - label_len)
    x = F.slice(a, start + 1, c - start)
    y = F.slice(a, first + 1, F.least(n, c + pred_len) - first)
    one = lambda v: F.transform(v, lambda _: F.lit(1.0))
    total = pred_len + label_len
    return d.withColumns({"insample": _pad_left(x, seq_len), "insample_mask": _pad_left(one(x), seq_len),
                          "outsample": _pad_right(y, total), "outsample_mask": _pad_right(one(y), total)})


# --- folds: small tables [lo, hi) per series, from the series lengths alone ----------------

def _folds(lengths: DataFrame, splits: int, roles: dict[str, tuple[Column, Column]], keep: Column, keys: Sequence[str]) -> DataFrame:
    d = lengths.where("n > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).where(keep)
    rows = F.array(*[F.struct(F.lit(r).alias("role"), a.cast("bigint").alias("lo"), z.cast("bigint").alias("hi")) for r, (a, z) in roles.items()])
    return d.select(*keys, "fold", F.explode(rows).alias("f")).select(*keys, "fold", "f.*").where("hi > lo")


def expanding_folds(lengths: DataFrame, train: int, val: int, gap: int, test: int, step: int, splits: int, keys: Sequence[str] = KEYS) -> DataFrame:
    end = F.lit(train) + F.col("fold") * step
    start = F.greatest(F.lit(0), end - val)
    roles = {"train": (F.lit(0), start), "val": (start, end), "test": (end + gap, end + gap + test)}
    return _folds(lengths, splits, roles, end + gap + test <= F.col("n"), keys)


def blocked_folds(lengths: DataFrame, block: int, val: int, splits: int, keys: Sequence[str] = KEYS) -> DataFrame:
    blocks = F.floor(F.col("n") / block)
    allowed = F.when(blocks < splits + 1, F.greatest(F.lit(1), blocks - 1)).otherwise(splits)
    start = (F.col("fold") + 1) * block
    end = F.least(start + block, F.col("n"))
    size = F.least(F.lit(val), F.floor(start / 4))
    roles = {"train": (F.lit(0), start - size), "val": (start - size, start), "test": (start, end)}
    return _folds(lengths, splits, roles, (F.col("fold") < allowed) & (end > start), keys)


def purged_folds(lengths: DataFrame, train: int, val: int, test: int, step: int, splits: int, purge: int, embargo: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Training ends ``purge`` rows before the test; ``embargo`` rows must follow it."""
    start = F.lit(train) + F.col("fold") * step
    end = start - purge
    size = F.least(F.lit(val), F.floor(end / 4))
    roles = {"train": (F.lit(0), end - size), "val": (end - size, end), "test": (start, start + test)}
    return _folds(lengths, splits, roles, start + test + embargo <= F.col("n"), keys)


def walk_forward_windows(lengths: DataFrame, train: int, val: int, step: int, most: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every window that fits, ``step`` rows apart; ``most`` limits them where that is wanted."""
    last = F.floor((F.col("n") - train - val) / step)
    last = last if most is None else F.least(last, F.lit(most - 1))
    d = lengths.where(F.col("n") >= train + val).withColumn("fold", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    start = (F.col("fold") * step).cast("bigint")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), (start + a).alias("lo"), (start + z).alias("hi")) for r, a, z in (("train", 0, train), ("val", train, train + val))])
    return d.select(*keys, "fold", F.explode(roles).alias("f")).select(*keys, "fold", "f.*").where("hi > lo")


def leakage_check(folds: DataFrame, gap: int = 0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per fold: 1 if train or validation rows overlap test rows; 1 if training ends within the gap."""
    def edge(role: str, name: str, f) -> Column:
        return f(F.when(F.col("role") == role, F.col(name)))

    f = folds.groupBy(*keys, "fold").agg(
        edge("train", "lo", F.min).alias("tl"), edge("train", "hi", F.max).alias("th"), edge("val", "lo", F.min).alias("vl"),
        edge("val", "hi", F.max).alias("vh"), edge("test", "lo", F.min).alias("sl"), edge("test", "hi", F.max).alias("sh"),
    )
    cross = lambda lo, hi: F.coalesce((F.col(lo) < F.col("sh")) & (F.col("sl") < F.col(hi)), F.lit(False))
    return f.select(
        *keys, "fold", (cross("tl", "th") | cross("vl", "vh")).cast("int").alias("overlaps"),
        F.coalesce((F.col("th") - 1 >= F.col("sl") - gap).cast("int"), F.lit(0)).alias("within_gap"),
    )


# --- time encodings ------------------------------------------------------------------------

def time_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"month": F.month("ts"), "day": F.dayofmonth("ts"), "weekday": F.weekday("ts"), "hour": F.hour("ts"),
         "quarter_hour": F.floor(F.minute("ts") / 15).cast("int")}
    )


# Which encodings a frequency uses.
BY_FREQUENCY = {
    "Y": [], "Q": ["month_of_year"], "M": ["month_of_year"], "W": ["day_of_month", "week_of_year"],
    "D": ["day_of_week", "day_of_month", "day_of_year"], "B": ["day_of_week", "day_of_month", "day_of_year"],
    "H": ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "T": ["minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year"],
}


def time_features(df: DataFrame, frequency: str) -> DataFrame:
    """Calendar encodings in [-0.5, 0.5] for a frequency Y, Q, M, W, D, B, H, T or S."""
    parts = {
        "second_of_minute": F.second("ts") / 59.0 - 0.5, "minute_of_hour": F.minute("ts") / 59.0 - 0.5, "hour_of_day": F.hour("ts") / 23.0 - 0.5,
        "day_of_week": F.weekday("ts") / 6.0 - 0.5, "day_of_month": (F.dayofmonth("ts") - 1) / 30.0 - 0.5, "day_of_year": (F.dayofyear("ts") - 1) / 365.0 - 0.5,
        "month_of_year": (F.month("ts") - 1) / 11.0 - 0.5, "week_of_year": (F.weekofyear("ts") - 1) / 52.0 - 0.5,
    }
    return df.withColumns({n: parts[n] for n in BY_FREQUENCY[frequency]})


def future_stamps(last: DataFrame, step_seconds: int, count: int) -> DataFrame:
    """``count`` timestamps after the given one per row, ``step_seconds`` apart."""
    d = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return d.withColumn("ts", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("step") * step_seconds))
