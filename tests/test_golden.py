"""Recorded figures that have to come out again (see FIXTURES.md, G1 and G2)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import evaluation as ev
from tideline.operators import quality as qu


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.RandomState(42)
    price = np.concatenate([[50000.0], 50000.0 * np.cumprod(1 + rng.normal(0.0001, 0.02, 199))])
    guess = np.zeros(200)
    guess[1:10] = price[:9]
    guess[10:] = [price[i - 10:i].mean() for i in range(10, 200)]
    pdf = pd.DataFrame({"model": "m", "series_key": "s", "ts": np.arange(200), "actual": price, "predicted": guess})
    return spark.createDataFrame(pdf).cache()


def test_trading_figures_match_the_record(walk):
    got = ev.trading_metrics(walk).first().asDict()
    want = {
        "total_return": -0.09194937575273876, "annualized_return": -0.9859819514016018, "annualized_volatility": 1.7695221578218414,
        "sharpe_ratio": -0.5572023763835073, "sortino_ratio": -0.8929123783666835, "calmar_ratio": -2.9666269474672804,
        "max_drawdown": -0.3323579165366145, "information_ratio": -1.5249953792903617, "win_rate": 0.47474747474747475,
        "profit_factor": 1.1041274173765578, "avg_win": 0.015590425486265554, "avg_loss": -0.014120132550742109,
        "total_trades": 198, "transaction_cost_impact": 0.058,
    }
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9), k


def test_errors_and_score_match_the_record(walk):
    e = ev.evaluate(walk, ["mse", "mae", "mape", "r2"]).first()
    assert e["mse"] == pytest.approx(14616497.728365615, rel=1e-9)
    assert e["mae"] == pytest.approx(1387.1324893664973, rel=1e-9)
    assert e["mape"] * 100 == pytest.approx(3.1431611649694573, rel=1e-9)
    assert e["r2"] == pytest.approx(-0.028779920422803196, rel=1e-6)
    m = ev.evaluate(walk, ["mape", "r2"]).withColumn("mape", F.col("mape") * 100).join(ev.trading_metrics(walk), ["model", "series_key"])
    assert m.select(ev.model_score().alias("s")).first()["s"] == pytest.approx(0.3221915893122332, rel=1e-9)


def test_value_at_risk_matches_the_record(walk):
    from pyspark.sql import Window

    w = Window.partitionBy("series_key").orderBy("ts")
    r = walk.select("series_key", (F.col("actual") / F.lag("actual").over(w) - 1).alias("ret"), (F.col("actual") - F.lag("actual").over(w)).alias("diff"))
    assert ev.value_at_risk(r, "ret", ["series_key"]).first()["var_95"] == pytest.approx(-0.02954309027598542, rel=1e-9)
    assert ev.value_at_risk(r, "diff", ["series_key"]).first()["expected_shortfall"] == pytest.approx(-1661.2008893784478, rel=1e-9)


def faulty_bars() -> pd.DataFrame:
    """Hourly bars with planted faults, drawn in the order FIXTURES.md states."""
    rng = np.random.RandomState(42)
    now, stamps = dt.datetime(2023, 1, 1, tzinfo=dt.timezone.utc), []
    for _ in range(1000):
        stamps.append(int(now.timestamp()))
        now += dt.timedelta(hours=int(rng.choice([2, 6, 24])) if rng.random_sample() < 0.05 else 1)
    level, out = 50000.0, []
    for i in range(1000):
        if i:
            step = rng.normal(0, 0.02)
            if rng.random_sample() < 0.01:
                step = rng.choice([-0.7, 0.8])
            level *= 1 + step
        o, c = (level * rng.uniform(0.995, 1.005) for _ in range(2))
        if rng.random_sample() < 0.05:
            h, low = min(o, c) * 0.999, max(o, c) * 1.001
        else:
            h = max(o, c) * rng.uniform(1.001, 1.01)
            low = min(o, c) * rng.uniform(0.99, 0.999)
        v = rng.lognormal(10, 1)
        v = -v if rng.random_sample() < 0.02 else v
        v = v * 50 if rng.random_sample() < 0.01 else v
        out.append((o, h, low, c, v))
    pdf = pd.DataFrame(out, columns=["open", "high", "low", "close", "volume"])
    pdf.insert(0, "stamp", stamps)
    gone = rng.choice(pdf.index, size=30, replace=False)
    for i, c in zip(gone, rng.choice(["open", "high", "low", "close", "volume"], size=30)):
        pdf.loc[i, c] = np.nan
    for i in rng.choice(pdf.index[:-1], size=5, replace=False):
        pdf.loc[i + 1, "stamp"] = pdf.loc[i, "stamp"]
    return pdf.assign(series_key="s", seq=range(1000))


def test_quality_checks_match_the_record(spark):
    from tideline.functions.nulls import nan_to_null

    df = nan_to_null(spark.createDataFrame(faulty_bars())).withColumn("ts", F.timestamp_seconds("stamp")).drop("stamp")
    m = qu.measure(df).cache()
    row = m.first().asDict()
    assert sum(row[f"missing_{c}"] for c in qu.NUMERIC) == 30
    assert row["n"] - row["n_distinct_ts"] == 5 and row["negative_volume"] == 18 and row["volume_spikes"] == 69
    assert [row[f"jumps_{c}"] for c in qu.PRICES] == [18] * 4 and [row[f"outliers_{c}"] for c in qu.PRICES] == [152] * 4
    assert (row["high_violations"], row["low_violations"], row["high_low_violations"]) == (40, 41, 40)
    assert row["volume_cv"] == pytest.approx(4.1209593804233595, rel=1e-9) and row["max_gap_hours"] == 24
    assert [round(row[f"skew_{c}"], 2) for c in ("open", "high", "low", "close", "volume")] == [6.89, 6.81, 6.80, 6.81, 9.82]
    checks = qu.quality_checks(m).cache()
    got = {r["check_name"]: r["score"] for r in checks.collect()}
    want = {"Data Completeness": 0.9, "Data Consistency": 0.5, "Price Integrity": 0, "Volume Integrity": 0.7, "Temporal Integrity": 0.8,
            "OHLC Relationships": 0, "Statistical Properties": 0.5, "External Data Alignment": 1.0}
    assert got == pytest.approx(want)
    assert qu.overall_score(checks).first()["overall_score"] == pytest.approx(0.775)


@pytest.mark.parametrize("pred,true,want", [([1, 2, 3, 4], [1, 3, 2, 5], 2 / 3), ([1, 2, 3, 4], [2, 3, 4, 5], 1.0), ([1, 2, 3, 4], [4, 3, 2, 1], 0.0)])
def test_directional_accuracy_vectors(spark, pred, true, want):
    pdf = pd.DataFrame({"model": "m", "series_key": "s", "ts": range(4), "actual": np.array(true, float), "predicted": np.array(pred, float)})
    assert ev.evaluate(spark.createDataFrame(pdf), ["mda"]).first()["mda"] == pytest.approx(want)


def test_drift_shows_in_moved_columns_only(spark):
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame({"series_key": "s", **{c: rng.uniform(90, 110, 300) for c in qu.NUMERIC}})
    base = spark.createDataFrame(pdf)
    moved = base.withColumns({"close": F.col("close") * 1.2, "volume": F.col("volume") * 2})
    got = {r["column"]: r["significant"] for r in qu.drift(base, moved).collect()}
    assert got == {"open": 0, "high": 0, "low": 0, "close": 1, "volume": 1}
    assert all(r["drift_score"] == 0 for r in qu.drift(base, base).collect())
