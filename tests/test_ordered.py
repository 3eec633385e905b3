"""Split work on one long series equals the plain result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.rolling import add_ema, ema_lookback
from tideline.operators import indicators as ind
from tideline.operators import ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; times have gaps, values have NULLs."""
    rng = np.random.RandomState(3)
    parts = []
    for k, n in (("hot", 900), ("b", 40), ("c", 1)):
        t = np.sort(rng.choice(20000, n, replace=False))
        parts.append(pd.DataFrame({"series_key": k, "pos": t, "x": rng.normal(100, 10, n)}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds(F.col("pos") * 60))
    return df.withColumn("y", F.when(F.col("pos") % 4 == 0, F.col("x"))).cache()


def rows(df, *cols):
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("series_key", "pos", *cols).collect())


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("width", [500, 100000])
def test_running_equals_plain_window(skewed, before, width):
    exprs = {
        "s": ("sum", F.col("y")), "n": ("count", F.col("y")), "hi": ("max", F.col("x")), "lo": ("min", F.col("y")),
        "l": ("last", F.col("y")), "f": ("first", F.col("y")),
    }
    plain = od.running(skewed, ["series_key"], ["pos"], exprs, before=before)
    split = od.running(skewed, ["series_key"], ["pos"], exprs, od.id_bucket("pos", width), before=before)
    assert rows(plain, *exprs) == rows(split, *exprs)


def test_ordinal_counts_over_slices(skewed):
    a = od.ordinal(skewed, ["series_key"], ["pos"], None)
    b = od.ordinal(skewed, ["series_key"], ["pos"], od.id_bucket("pos", 300))
    assert rows(a, "rn") == rows(b, "rn")


@pytest.mark.parametrize("chunk", [7, 64])
def test_chunks_equal_plain_windows(skewed, chunk):
    bars = skewed.withColumns({c: F.col("x") for c in ("open", "high", "low", "close")} | {"volume": F.col("x") * 2})
    features = [ind.moving_average_features((5, 20)), ind.rsi_features((14,)), ind.lag_features(("close",), (1, 3))]
    names = ["sma_5", "sma_20", "rsi_14", "close_lag_1", "close_lag_3"]
    plain = ind.add_features(bars, features)
    split = od.over_chunks(bars, lambda d, k: ind.add_features(d, features, k), ["series_key"], ["ts"], od.time_bucket(86400), 30, chunk)
    assert rows(plain, *names) == rows(split, *names)


def test_lookahead_rows_come_along(skewed):
    def fn(d, keys):
        return d.withColumn("nxt", F.lead("x", 3).over(Window.partitionBy(*keys).orderBy("pos")))

    split = od.over_chunks(skewed, fn, ["series_key"], ["pos"], od.id_bucket("pos", 700), 0, 16, lookahead=3)
    assert rows(fn(skewed, ["series_key"]), "nxt") == rows(split, "nxt")


@pytest.mark.parametrize("adjust", [True, False])
def test_ema_equals_pandas(skewed, adjust):
    got = add_ema(skewed, {"e": (F.col("x"), 5), "g": (F.col("x"), 26)}, ["series_key"], ["pos"], adjust=adjust).toPandas().sort_values(["series_key", "pos"])
    for c, span in (("e", 5), ("g", 26)):
        want = got.groupby("series_key")["x"].transform(lambda s, span=span: s.ewm(span=span, adjust=adjust).mean())
        assert np.allclose(got[c], want, rtol=1e-11)


def test_ema_in_chunks(skewed):
    fn = lambda d, k: add_ema(d, {"e": (F.col("x"), 9)}, k, ["pos"])
    split = od.over_chunks(skewed, fn, ["series_key"], ["pos"], od.id_bucket("pos", 3000), ema_lookback([9]), 64)
    assert rows(fn(skewed, ["series_key"]), "e") == rows(split, "e")


def test_exact_quantiles(skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    rounded = skewed.withColumn("x", F.round("x"))  # many copies of each value
    got = {(r["series_key"], r["prob"]): r["quantile"] for r in od.exact_quantiles(rounded, ["series_key"], "x", probs, 16).collect()}
    pdf = rounded.toPandas()
    for k, g in pdf.groupby("series_key"):
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(g["x"], p)), (k, p)
    whole = od.exact_quantiles(rounded, [], "x", [0.5]).first()["quantile"]
    assert whole == pytest.approx(np.quantile(pdf["x"], 0.5))


@pytest.mark.parametrize("n,accuracy", [(7, 100), (3000, 1000), (30_000, 1000)])
def test_exact_quantiles_of_few_and_many_values(spark, n, accuracy):
    """Groups below and above the size from which the sketch cuts rows out; skewed values, ties, nulls and an empty group."""
    import random

    r = random.Random(n)
    rows = [("a", r.choice([None, round(r.lognormvariate(0, 3), 1), 5.0])) for _ in range(n)] + [("b", None), ("c", 1.0), ("c", float("-inf"))]
    probs = [0.0, 0.01, 0.3, 0.5, 0.999, 1.0]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(q["k"], q["prob"]): q["quantile"] for q in od.exact_quantiles(df, ["k"], "x", probs, accuracy).collect()}
    a = [x for k, x in rows if k == "a" and x is not None]
    assert all(got["a", p] == pytest.approx(np.quantile(a, p)) for p in probs)
    assert got["c", 0.0] == float("-inf") and not any(k == "b" for k, _ in got)


def test_exact_quantiles_count_few_rows_by_value(spark):
    """Of a large group only the rows around the wanted ranks are grouped by value."""
    from pyspark.sql import functions as F

    df = spark.range(400_000).select(F.lit("a").alias("k"), F.xxhash64("id").cast("double").alias("x"))
    out = od.exact_quantiles(df, ["k"], "x", [0.25, 0.5], 2000)
    rows = out._jdf.queryExecution()
    assert out.count() == 2
    text = rows.toString()
    assert "percentile_approx" in text
    x = np.sort(df.toPandas()["x"].to_numpy())
    assert {r["prob"]: r["quantile"] for r in out.collect()} == {p: pytest.approx(np.quantile(x, p)) for p in (0.25, 0.5)}


def ticks(spark, n, seconds):
    """A hot series whose rows crowd: half of them in one hour, a quarter of these in one minute; and a calm one."""
    i = F.col("id")
    at = F.when(i % 8 == 0, 7200 + (i * 7 % 60_000) / 1000).when(i % 2 == 0, 7200 + (i * 13 % 3_600_000) / 1000).otherwise(i * 31 % (seconds * 1000) / 1000)
    hot = spark.range(n).select(F.lit("hot").alias("series_key"), F.timestamp_micros((at * 1_000_000).cast("bigint")).alias("ts"), i.alias("seq"), (i % 97).cast("double").alias("x"))
    calm = spark.range(50).select(F.lit("calm").alias("series_key"), F.timestamp_micros(F.col("id") * 9_000_000_000).alias("ts"), F.col("id").alias("seq"), F.lit(1.0).alias("x"))
    return hot.unionAll(calm)


def largest(df, slices):
    return slices.add(df, ["series_key"]).groupBy("series_key", "__bucket").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("factor", [1, 100])
def test_slices_hold_few_rows_at_any_rate(spark, factor):
    """A hundred times the ticks in the same month: the largest group stays below the bound."""
    df, slices = ticks(spark, 3000 * factor, 30 * 86_400), od.Slices(86_400, 2000)
    assert largest(df, slices) <= 2000
    fixed = df.groupBy("series_key", F.floor(F.unix_timestamp("ts") / 86_400)).count().agg(F.max("count")).first()[0]
    assert fixed > 1000 * factor  # what a slice of fixed width would hold


def test_slices_follow_the_time_and_calm_stretches_stay_whole(spark):
    df = ticks(spark, 20_000, 10 * 86_400)
    cut = od.Slices(86_400, 500).add(df, ["series_key"])
    w = Window.partitionBy("series_key").orderBy("ts")
    assert cut.withColumn("__last", F.lag("__bucket").over(w)).where("__last > __bucket").count() == 0
    assert cut.where("series_key = 'calm'").select("__bucket").distinct().count() == 6
    assert cut.columns == [*df.columns, "__bucket"]


def test_running_over_crowded_slices_equals_a_plain_window(spark):
    df = ticks(spark, 4000, 5 * 86_400)
    exprs = {"s": ("sum", F.col("x")), "l": ("last", F.when(F.col("seq") % 3 == 0, F.col("x"))), "n": ("count", F.lit(1), True)}
    get = lambda d: sorted(tuple(r) for r in d.select("series_key", "seq", *exprs).collect())
    assert get(od.running(df, ["series_key"], ["ts", "seq"], exprs)) == get(od.running(df, ["series_key"], ["ts", "seq"], exprs, od.Slices(86_400, 100)))


def test_asof_over_crowded_slices_equals_a_plain_one(spark):
    from tideline.operators.joins import asof_join

    df = ticks(spark, 3000, 2 * 86_400)
    right = df.where("seq % 5 = 0").select("series_key", "ts", "seq", F.col("x").alias("mark"))
    get = lambda **more: sorted(str(tuple(r)) for r in asof_join(df.withColumnRenamed("seq", "id"), right, **more).collect())
    assert get() == get(bucket=od.Slices(3600, 64))
