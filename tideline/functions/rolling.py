"""Window expressions over an ordered series.

Every function takes ``w``, the ordered window of one series (no frame). All frames of
one ``w`` share a single exchange and sort, so features are added side by side for free.
A rolling value is NULL until the frame holds ``n`` non-null observations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.nulls import INF, ratio


def series_window(keys: Sequence[str], order: Sequence[str] = ("ts",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def from_end(keys: Sequence[str], order: Sequence[str] = ("ts",)) -> WindowSpec:
    """Current row to the end of the series, as a growing frame over descending order.

    A frame that ends in UNBOUNDED FOLLOWING is aggregated anew for every row.
    """
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    f = last_rows(w, n)
    return F.when(F.count(x).over(f) == n, agg(x).over(f))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, x, n, w)


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x - F.lag(x, n).over(w)


def pct_change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return ratio(x, F.lag(x, n).over(w)) - 1


def log_return(x: Column, w: WindowSpec) -> Column:
    return F.ln(ratio(x, F.lag(x).over(w)))


def strength(gain: Column, loss: Column) -> Column:
    """100 - 100/(1 + gain/loss): 100 when only the loss is zero, NULL when both are."""
    return (
        F.when(loss != 0, 100 - ratio(F.lit(100.0), 1 + ratio(gain, loss)))
        .when(gain > 0, F.lit(100.0))
    )


def mean_and_spread(x: Column, n: int, w: WindowSpec) -> tuple[Column, Column]:
    return rolling(F.avg, x, n, w), rolling(F.stddev_samp, x, n, w)


# --- exponentially weighted mean -------------------------------------------------------
#
# y_t = sum((1-a)^i x_{t-i}) / sum((1-a)^i). Rows are cut into blocks of M positions, M so
# long that a weight M rows old is below 1e-17. Inside a block the weighted sum is a plain
# running sum of x * d^-position, rescaled by d^position; the block before enters once,
# through a range frame; anything older is below double precision. Constant work per row,
# where a frame of K past rows would cost K per row.

_NEGLIGIBLE = 40.0  # exp(-40) ~ 4e-18


def ema_block_rows(spans: Sequence[int]) -> int:
    """Block length that serves all spans with one sort."""
    return max(math.ceil(_NEGLIGIBLE / -math.log(1 - 2 / (s + 1))) for s in spans if s > 1)


def ema_lookback(spans: Sequence[int]) -> int:
    return 2 * ema_block_rows(spans)


def add_ema(
    df: DataFrame,
    columns: dict[str, tuple[Column, int]],
    keys: Sequence[str],
    order: Sequence[str] = ("ts",),
    block_rows: int | None = None,
    adjust: bool = True,
    keep_blocks: bool = False,
) -> DataFrame:
    """Add exponentially weighted means ``{name: (expression, span)}``.

    Inputs must be non-null from some row on: leading NULLs do not count, later ones raise
    the age of the observations before them, as a missing row would. ``keep_blocks`` leaves
    the block columns in place, so that a second call (a mean of a mean) needs no new sort.
    """
    spans = [s for _, s in columns.values()]
    m = block_rows or ema_block_rows(spans)
    if max(m * -math.log(1 - 2 / (s + 1)) for s in spans if s > 1) > 600:
        raise ValueError("spans too far apart for one block length: add them in two calls")
    pos, block = F.col("__pos"), "__block"
    here = series_window([*keys, block], order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(block).rangeBetween(-1, -1)
    if block not in df.columns:
        if "__row" not in df.columns:
            df = df.withColumn("__row", F.row_number().over(series_window(keys, order)) - 1)
        df = df.withColumns({block: F.floor(F.col("__row") / m), "__pos": F.col("__row") % m})
    out = {}
    for name, (x, span) in columns.items():
        alpha = 2 / (span + 1)
        d = 1 - alpha
        if span == 1:
            out[name] = x
            continue
        up, down = F.pow(F.lit(d), -pos.cast("double")), F.pow(F.lit(d), pos.cast("double"))
        left = F.pow(F.lit(d), (m - 1 - pos).cast("double"))

        def weighted(v: Column) -> Column:
            carried = F.coalesce(F.sum(v * left).over(before), F.lit(0.0))
            return down * (F.sum(v * up).over(here) + F.lit(d) * carried)

        seen = F.when(x.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
        value = F.coalesce(x, F.lit(0.0))
        if adjust:
            out[name] = F.when(x.isNotNull(), ratio(weighted(value), weighted(seen)))
        else:
            # y_0 = x_0, y_t = a x_t + d y_{t-1}: the first value carries weight 1
            weight = F.when(F.col("__row") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
            out[name] = F.when(x.isNotNull(), weighted(value * weight))
    added = df.withColumns(out)
    return added if keep_blocks else added.drop("__row", block, "__pos")
