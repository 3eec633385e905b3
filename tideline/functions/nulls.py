"""Missing values: NaN never enters a comparison, division never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column (NaN > 1 is true in Spark)."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(a, b)


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Limit x to [lo, hi]; NULL stays NULL (greatest and least alone would drop it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.when(cond, 1).otherwise(0)


def share(cond: Column) -> Column:
    """Aggregate: share of rows where the condition holds."""
    return F.avg(flag(cond).cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r on rows where both are present, NULL when one is constant.

    The built-in ``corr`` raises a division error on constant input under ANSI rules.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def text_hash(*parts: Column) -> Column:
    """52 bits of the MD5 digest of the parts' text joined by bars: a number that any SQL engine can state."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[x.cast("string") for x in parts])), 1, 13), 16, 10).cast("bigint")
