"""Quality figures at their edges."""

from pyspark.sql import functions as F

from tideline.operators import quality as qu


def test_value_on_the_fence_is_no_outlier(spark):
    """The largest price equals q3 + 1.5 * (q3 - q1), though weighing neighbours puts the fence a last bit below."""
    prices = [100.66, 100.66, 100.8, 100.8, 102.38, 103.92]
    df = spark.createDataFrame([(s, p) for s, k in ((1, 1.0), (2, 1.01)) for p in [*prices[:-1], prices[-1] * k]], "series_key int, close double")
    got = {r["series_key"]: r["outliers"] for r in qu.column_profile(df, ["close"]).collect()}
    assert got == {1: 0, 2: 1}


def test_quartiles_of_missing_and_single_values(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None), (3, 1.0), (3, 2.0)], "series_key int, x double")
    got = qu.column_profile(df, ["x"]).select("series_key", "n_rows", "missing", "median", "outliers").orderBy("series_key").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 2.0, 0), (2, 1, 1, None, 0), (3, 2, 0, 1.5, 0)]


def test_fences_of_the_price_check(spark):
    """``measure`` flags beyond three ranges; the values here lie between the fences of both rules."""
    prices = [100.66, 100.66, 100.8, 100.8, 102.38, 103.92]
    df = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate(prices)], "series_key int, seq int, close double").select(
        "series_key", F.timestamp_seconds(F.col("seq") * 86400).alias("ts"), "seq", *[F.col("close").alias(c) for c in qu.PRICES], F.lit(1.0).alias("volume")
    )
    got = qu.measure(df).first()
    assert [got[f"outliers_{c}"] for c in qu.PRICES] == [0] * 4
