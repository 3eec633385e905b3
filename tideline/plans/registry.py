"""Named queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tie_shift(digits: int) -> float:
    return 3 * 10.0 ** -(digits + 3)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every DOUBLE: sums add up in another order on every run.

    The small shift moves exact ties (prices are whole cents) off the rounding boundary.
    """
    return df.select(
        *[
            (F.round(F.col(f.name) + F.lit(tie_shift(digits)), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Register a query; ``floats`` names the DOUBLE columns the SQL has to round alike."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(prepare(spark), sf_dir.rstrip("/")), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            cols = floats.split()
            ORACLES[name] = (
                f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + {tie_shift(digits)!r}::DOUBLE, {digits}) + 0.0 AS {c}' for c in cols)}) FROM (\n{sql}\n) AS answer"
                if cols
                else sql
            )
        return fn

    return register
