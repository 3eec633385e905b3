import random

import pytest

from tideline.operators import trials as tr


def brute(points, signs, reference):
    """Ids of the front by all pairs."""
    out = set()
    for i, g, *x in points:
        if any(v is None for v in x):
            continue
        a = [s * v for s, v in zip(signs, x, strict=True)]
        beaten = False
        for j, h, *y in points:
            if h == g and j != i and all(v is not None for v in y):
                b = [s * v for s, v in zip(signs, y, strict=True)]
                if all(q <= p for p, q in zip(a, b, strict=True)) and (reference or a != b):
                    beaten = True
                    break
        if not beaten:
            out.add(i)
    return out


def points(seed, n, m, kind):
    r = random.Random(seed)
    for i in range(n):
        x = [r.random() for _ in range(m)]
        if kind == "against":  # good in one metric means bad in another: nearly all are on the front
            x = [v / sum(x) for v in x]
        if kind == "ties":
            x = [float(r.randrange(4)) for _ in range(m)]
        if kind == "gaps" and r.random() < 0.2:
            x[r.randrange(m)] = None
        yield (i, r.choice("uv"), *x)


@pytest.mark.parametrize("kind,m", [("even", 3), ("against", 3), ("ties", 4), ("gaps", 2), ("even", 5), ("even", 1)])
@pytest.mark.parametrize("mode", ["strict", "reference"])
def test_equals_all_pairs(spark, kind, m, mode, monkeypatch):
    monkeypatch.setattr(tr, "CHUNK", 50)
    rows = list(points(m, 400, m, kind))
    names = [f"m{j}" for j in range(m)]
    signs = [1 if j % 2 == 0 else -1 for j in range(m)]
    df = spark.createDataFrame(rows, "id int, study string, " + ", ".join(f"{n} double" for n in names))
    front = tr.skyline(df, {n: "low" if s > 0 else "high" for n, s in zip(names, signs, strict=True)}, mode=mode)
    assert front.columns == df.columns
    assert {r["id"] for r in front.collect()} == brute(rows, signs, mode == "reference")


def test_without_groups_and_empty(spark):
    rows = [(i, "u", float(i % 5), float(-i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, study string, a double, b double")
    assert {r["id"] for r in tr.skyline(df, {"a": "low", "b": "high"}, by=()).collect()} == brute(rows, [1, -1], False)
    assert tr.skyline(df.limit(0), {"a": "low", "b": "high"}).count() == 0
