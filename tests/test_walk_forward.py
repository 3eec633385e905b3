from datetime import datetime, timedelta

import pytest

from tideline.operators import forecasting as fc
from tideline.operators import splits as sp


def series(spark, lengths):
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=i), float((i * 37) % 101)) for k, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "series_key string, ts timestamp, close double")


def model():
    """Depends on the training rows, their order and the validation rows' places."""

    def predict(train, val):
        base = (train["close"] * range(1, len(train) + 1)).sum() / train["rn"].max()
        return [base + x for x in val["rn"]]

    return predict


def brute(lengths, windows):
    out = []
    for k, n in lengths.items():
        x = [float((i * 37) % 101) for i in range(n)]
        for fold, (a, b, c) in enumerate(windows(n)):
            base = sum(v * (i + 1) for i, v in enumerate(x[a:b])) / (b - 1)
            out += [(k, fold, i, x[i], round(base + i, 6)) for i in range(b, c)]
    return sorted(out)


def found(df, start=datetime(2024, 1, 1)):
    return sorted((r["series_key"], r["fold"], int((r["ts"] - start).total_seconds() // 3600), r["actual"], round(r["predicted"], 6)) for r in df.collect())


@pytest.mark.parametrize("stretch,train,val,step", [(1, 20, 5, 3), (64, 20, 5, 3), (1, 30, 30, 60), (4096, 10, 2, 1)])
def test_overlapping_windows_share_stretches(spark, monkeypatch, stretch, train, val, step):
    """Windows that start in one stretch and end in the next, in series shorter and longer than a stretch."""
    monkeypatch.setattr(fc, "STRETCH", stretch)
    lengths = {"long": 310, "short": 40, "none": 7}
    df = series(spark, lengths)
    windows = sp.walk_forward_windows(sp.series_lengths(df), train, val, step)
    got = fc.walk_forward(sp.positioned(df), windows, model())
    assert found(got) == brute(lengths, lambda n: [(a, a + train, a + train + val) for a in range(0, n - train - val + 1, step)])


def test_rows_are_sent_to_two_stretches_at_most(spark, monkeypatch):
    monkeypatch.setattr(fc, "STRETCH", 1)
    df = sp.positioned(series(spark, {"a": 500}))
    windows = sp.walk_forward_windows(sp.series_lengths(df), 50, 10, 1)  # every row lies in 60 windows

    def count(train, val):
        return [float(len(train))] * len(val)

    got = fc.walk_forward(df, windows, count)
    assert got.where("predicted <> 50").count() == 0 and got.count() == 441 * 10
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate explode(sequence(greatest(") == 1


def test_no_windows(spark):
    df = sp.positioned(series(spark, {"a": 5}))
    assert fc.walk_forward(df, sp.walk_forward_windows(sp.series_lengths(df), 50, 10, 1), model()).count() == 0


def test_a_model_gives_a_value_for_every_row(spark):
    df = series(spark, {"a": 80})
    windows = sp.walk_forward_windows(sp.series_lengths(df), 50, 10, 5)
    with pytest.raises(Exception, match="gave 1 values for 10 rows"):
        fc.walk_forward(sp.positioned(df), windows, lambda train, val: [0.0]).count()
