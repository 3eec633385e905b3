import math
import random

import pytest

from tideline.operators import cleaning as cl

SCHEMA = "series_key string, ts int, y double, a double, b double, c double"


def brute(rows, names, k):
    """y of every row: its own, or the mean of the k nearest of its series that have one."""
    out = {}
    for key, ts, y, *x in rows:
        if y is None:
            near = []
            for other, t, z, *v in rows:
                gaps = [(p - q) * (p - q) for p, q in zip(x[:names], v[:names], strict=True) if p is not None and q is not None]
                if other == key and z is not None and gaps:
                    near.append((math.sqrt(sum(gaps) * names / len(gaps)), t, z))
            near = [z for *_, z in sorted(near)[:k]]
            y = sum(near) / len(near) if near else None
        out[key, ts] = y
    return out


def agrees(spark, rows, names, k=5):
    got = cl.impute_knn(spark.createDataFrame(rows, SCHEMA), "y", ["a", "b", "c"][:names], k)
    want = brute(rows, names, k)
    for r in got.collect():
        w = want[r["series_key"], r["ts"]]
        assert (r["y"] is None) == (w is None) and (w is None or math.isclose(r["y"], w, rel_tol=1e-9)), (r, w)
    assert got.count() == len(rows)


def table(seed, n, gap, missing, spread):
    r = random.Random(seed)
    value = lambda scale: None if r.random() < missing else round(r.gauss(0, scale) * (50 if r.random() < 0.02 else 1), 2)
    return [(r.choice("uvw"), t, None if r.random() < gap else float(t), *(value(s) for s in spread)) for t in range(n)]


@pytest.mark.parametrize("names,missing", [(1, 0.0), (2, 0.1), (3, 0.3)])
def test_equals_all_distances(spark, names, missing):
    """Donors far along the series, features of different scales, rare values far out, missing features."""
    agrees(spark, table(names, 500, 0.2, missing, (1.0, 5.0, 0.1)), names)


def test_few_donors_and_none(spark):
    rows = [("u", t, 1.0 if t < 3 else None, float(t), None, None) for t in range(40)]
    rows += [("v", t, None, 1.0, 1.0, 1.0) for t in range(3)] + [("w", 0, 2.0, None, None, None), ("w", 1, None, 1.0, None, None), ("x", 0, None, None, None, None), ("x", 1, 5.0, 1.0, 1.0, 1.0)]
    agrees(spark, rows, 2)


def test_equal_features_go_by_order(spark):
    agrees(spark, [("u", t, None if t % 3 == 0 else float(t), 7.0, 7.0, 7.0) for t in range(60)], 3)


def test_a_donor_of_the_whole_series_is_found(spark):
    """The nearest rows by features lie 500 rows away."""
    rows = [("u", t, None if t == 0 else float(t), 0.0 if t in (0, *range(500, 505)) else 100.0 + t, None, None) for t in range(520)]
    got = {r["ts"]: r["y"] for r in cl.impute_knn(spark.createDataFrame(rows, SCHEMA), "y", ["a"]).collect()}
    assert got[0] == 502.0


def test_a_dense_series_gets_all_its_neighbours(spark):
    """Over twenty thousand rows of one series, which cells make a join of few rows each."""
    from pyspark.sql import functions as F

    n = 20_000
    rows = spark.range(n).select(F.lit("u").alias("series_key"), F.col("id").alias("__i"), F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("__y"), F.array((F.col("id") * 7919 % n).cast("double"), (F.col("id") * 104729 % n).cast("double")).alias("__x"))
    from tideline.session import written

    found = cl.nearest(written(rows, "dense"), 5, 2)
    assert found.groupBy("__i").count().where("count = 5").count() == n // 10


def test_bounds_lose_no_donor(monkeypatch):
    """Few donors for the bound, few pairs at once, missing, infinite and undefined features: the same rows as from all distances."""
    import numpy as np

    for name, value in (("AROUND", 4), ("LOOKERS", 7), ("PAIRS", 20)):
        monkeypatch.setattr(cl, name, value)
    rng = np.random.default_rng(8)
    for n, k in ((1, 1), (2, 3), (4, 5), (4, 40)):
        x = np.round(rng.normal(0, (1.0, 8.0, 0.1, 3.0)[:n], (300, n)), 1)
        x[rng.random((300, n)) < 0.01], x[rng.random((300, n)) < 0.01] = np.inf, np.nan
        mask = rng.integers(0, 1 << n, 300) | (rng.random(300) < 0.6) * ((1 << n) - 1)
        blank, i = rng.random(300) < 0.3, rng.permutation(300)
        got = {}
        for row, far, donor in zip(*cl._nearest_rows(x, mask, blank, i, k), strict=True):
            got.setdefault(int(row), []).append((far, int(i[donor])))
        for row in np.flatnonzero(blank):
            want = []
            for d in np.flatnonzero(~blank):
                if shared := [j for j in range(n) if (mask[row] & mask[d]) >> j & 1]:
                    with np.errstate(all="ignore"):
                        gaps = [(x[row, j] - x[d, j]) ** 2 for j in shared]
                    far = math.sqrt(sum(gaps) * n / len(shared))
                    want.append((math.isnan(far), 0.0 if math.isnan(far) else far, int(i[d])))
            assert [(math.isnan(f), 0.0 if math.isnan(f) else f, t) for f, t in got.get(int(row), [])] == sorted(want)[:k]


def test_neighbours_take_one_pass_over_the_series(spark, monkeypatch):
    """Rows are written once, whatever the distances; no round after round of joins, tables and counts."""
    names, plain = [], cl.written
    monkeypatch.setattr(cl, "written", lambda df, name="step": names.append(name) or plain(df, name))
    rows = [("u", t, None if t % 5 == 0 else float(t), float(t * t % 97) * (1000 if t % 50 == 0 else 1), float(t % 13), None) for t in range(400)]
    agrees(spark, rows, 2)
    assert names == ["knn"]
