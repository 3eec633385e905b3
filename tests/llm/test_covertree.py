import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import covertree as ct

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid bigint, x double, shard int, anchor string, block int, rank int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, 2.0, 3, "a", 4, 5, 6.0) for i, v, g in rows], SCHEMA).coalesce(1)


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    """All rows of the result from all scores, by integers."""
    part = [(i, [math.floor(256 * float(np.float32(c))) for c in v], g) for i, v, g in rows if g is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x, g) in enumerate(part):
        if i is None or i % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y, strict=True)), math.inf if j is None else j, b, h) for b, (j, y, h) in enumerate(part) if b != a and len(y) == len(x)]
        for p in sorted(s for s in scores if s[3] == g)[:positives]:
            there = [s for s in scores if s[3] != g and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            for rank, n in enumerate(sorted(there)[:negatives], 1):
                out.append((i, p[1], rank, n[1], -p[0], -n[0]))
    return sorted(str(tuple(None if c == math.inf else c for c in r)) for r in out)


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


def mine(df, every=100, **parameters):
    return ct.hard_negatives(df, F.col("vec_id") % every == 0, **parameters)


def random_rows(seed, n, length, groups):
    """Vectors of which most lie close to a few centres, with some exact copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, length))
    x = centres[rng.integers(groups, size=n)] * 0.2 + 0.1 * rng.normal(size=(n, length)) * (rng.random((n, 1)) < 0.8)
    return [(i, [float(c) for c in x[i]], int(rng.integers(3))) for i in range(n)]


def test_odd_rows(spark):
    v, w = [0.5, 0.25, -0.5], [0.4, 0.3, -0.4]
    rows = [
        (0, v, 1), (0, v, 1), (1, v, 1), (None, v, 1), (2, w, 2), (2, w, 2), (None, w, 3), (3, [0.1, 0.1, -0.1], 1), (4, [0.2, 0.2, -0.2], 2), (100, w, 2), (200, None, 1), (300, v, None),
        (400, [0.5, None, 1.0], 1), (500, [float("nan"), 1.0, 1.0], 1), (600, [float("inf"), 1.0, 1.0], 1), (700, [], 1), (800, [0.0, 0.0, 0.0], 1), (900, [-0.5, -0.25, 0.5], 1), (None, None, None), (1000, [0.5, 0.5], 1), (5, [0.4, 0.5], 1), (6, [0.3, 0.2], 2),
    ]
    got = mine(frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert mine(frame(spark, [])).count() == 0
    assert mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0


def test_very_large_components_do_not_break(spark):
    rows = [(100 * i, [3e38, float(i), -3e38], i % 2) for i in range(4)]
    assert mine(frame(spark, rows)).where("negative_score = 9223372036854775807 OR negative_score > 0").count() >= 0


@pytest.mark.parametrize("seed,length,shard,block", [(1, 8, 64, 4), (2, 24, 100, 50), (3, 3, 4096, 4096)])
def test_equals_all_scores(spark, seed, length, shard, block):
    """Over many small trees and blocks, and over one of each; ties among exact copies go by id."""
    rows = random_rows(seed, 400, length, 6)
    assert found(mine(frame(spark, rows), every=20, shard=shard, block=block)) == brute(rows, every=20)


def test_tree_covers_its_points():
    """Every node reaches all its points, children partition them, and centres stand apart by more than half the reach."""
    points = np.array([np.floor(256 * np.array(v)) for _, v, _ in random_rows(4, 700, 6, 5)])
    t = ct.Tree(points)
    most = (points**2).sum(1).max()
    x = np.column_stack([points, np.sqrt(most - (points**2).sum(1))])[t.order]
    for i in range(len(t.first)):
        own = np.arange(t.first[i], t.first[i] + t.count[i])
        assert np.sqrt(((x[own] - x[t.centre[i]]) ** 2).sum(1)).max() <= t.reach[i] * (1 + 1e-9) + 1e-9 and t.centre[i] in own
        kids = range(t.child[i], t.child[i] + t.children[i])
        if len(kids):
            assert sorted(k for c in kids for k in range(t.first[c], t.first[c] + t.count[c])) == own.tolist()
            centres = x[t.centre[list(kids)]]
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 1e18
            assert gaps.min() > t.reach[i] / 2 * (1 - 1e-9) and t.reach[list(kids)].max() <= t.reach[i] / 2 * (1 + 1e-9)
        else:
            assert t.count[i] <= ct.LEAF or t.reach[i] == 0


def test_search_skips_what_lies_outside_windows():
    """Points in close groups: a window that fits one group scores few others, and the result stays exact."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 60
    points = np.floor(np.repeat(centres, 50, 0) + rng.normal(size=(2000, 16)))
    t = ct.Tree(points)
    ids = np.arange(2000)
    row = {"length": 16, "points": points[t.order].tobytes(), "uid": ids[t.order].tobytes(), "vec_id": ids[t.order].tobytes(), "label": (ids[t.order] * 0).tobytes()}
    tree = ct.opened(row | {c: getattr(t, c).tobytes() for c in ("first", "count", "child", "children", "reach", "centre")})
    q = points[0]
    score = points @ q
    low, high = np.array([np.quantile(score, 0.5), -np.inf]), np.array([np.quantile(score, 0.6), -1.0])
    best = ct.Best(2, 10)
    scored = ct.search(tree, q, low, high, lambda label, uid: label == 0, best)
    for w in range(2):
        fit = np.flatnonzero((score >= low[w]) & (score <= high[w]))
        assert best.rows[w][1].tolist() == fit[np.lexsort((fit, -score[fit]))][:10].tolist()
    assert scored < 600
