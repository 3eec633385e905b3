import math

import numpy as np
import pytest

from tideline.llm import crosspolytope as cp

SCHEMA = "vec_id bigint, embedding array<float>, label int, node bigint, n int, key string, pair int, vector string, links int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "k", 4, "v", 5) for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    xs = [np.array(v, np.float32).astype(float) if usable(v) else None for _, v in rows]
    for i in range(n):
        for j in range(i):
            if xs[i] is not None and xs[j] is not None and len(xs[i]) == len(xs[j]) and xs[i] @ xs[j] / math.sqrt((xs[i] @ xs[i]) * (xs[j] @ xs[j])) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).extend([k] if k is not None else [])
    out = [(k, links[i], min(least[find(i)], default=None)) for i, (k, _) in enumerate(rows)]
    return [(k, x, c, k == c) for k, x, c in out]


def found(df):
    return sorted(map(str, map(tuple, df.collect())))


def groups(seed, sizes, length, spread):
    """Vectors around random centres."""
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.normal(size=length)
        centre /= np.linalg.norm(centre)
        out += [centre + spread * rng.normal(size=length) / math.sqrt(length) for _ in range(size)]
    return [(100 + int(i), [float(x) for x in out[i]]) for i in rng.permutation(len(out))]


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, v), (1, v), (2, v), (None, v), (3, [2 * x for x in v]), (4, [1.0, 2.0, 3.0, 4.1]), (5, [-x for x in v]), (6, None), (None, None), (7, []), (8, [0.0] * 4),
        (9, [1.0, None, 3.0, 4.0]), (10, [float("nan"), 1.0, 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0, 1.0]), (12, [5.0]), (13, [7.0]), (14, [-7.0]), (15, [1e30] * 4), (16, [3e38] * 4), (17, [1e-30] * 4),
        (None, [0.0, 0.0, 0.0, -1.0]), (18, [1.0, 2.0]), (19, [float(i) for i in range(100)]), (19, [float(i + (i == 50)) for i in range(100)]),
    ]
    got = cp.near_duplicates(frame(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert found(got) == sorted(str(x) for x in brute(rows))


def test_empty_table(spark):
    assert cp.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed,length,spread", [(1, 64, 0.15), (2, 24, 0.2), (3, 100, 0.1)])
def test_groups_equal_all_pairs(spark, seed, length, spread):
    rows = groups(seed, [1] * 60 + [2] * 20 + [5] * 10 + [90], length, spread)
    assert found(cp.near_duplicates(frame(spark, rows), recall=0.9999)) == sorted(str(x) for x in brute(rows))


def test_tiles_find_what_one_tile_finds(spark):
    """A group cut into many tiles, and exact copies within it."""
    rows = groups(5, [150, 1, 1, 40], 32, 0.2)
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    assert found(cp.near_duplicates(frame(spark, rows), tile=16, recall=0.9999)) == sorted(str(x) for x in brute(rows))


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold meet in the tables that the sizes ask for, and unrelated ones rarely."""
    rng, rows = np.random.default_rng(9), 50_000
    hashes, tables = cp.sizes(rows, 64, 0.95, 0.995)
    a, b, far = rng.normal(size=(3, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    keys = [cp.keys_of(x, hashes, tables) for x in (a, b, far / np.linalg.norm(far, axis=1, keepdims=True))]
    near, strange = (np.logical_or(*cp._meet(keys[0], k)).any(1).mean() for k in keys[1:])
    assert near > 0.98 and strange < 0.02


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(cp.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cp.hadamard(cp.hadamard(x)), x)


def test_hot_key_of_a_lookup_is_dealt_out(spark):
    """Every row gets its key's fact, also where one key has most rows; rows without a fact go."""
    from pyspark.sql import functions as F

    from tideline.llm.common import salted_lookup

    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 50).cast("bigint").alias("k"))
    facts = rows.where("k <> 3").groupBy("k").agg(F.count("*").alias("c"), (F.max("k") * 2).alias("twice"))
    got = salted_lookup(rows, facts, "k", "c", F.xxhash64("id"))
    assert got.columns == ["id", "k", "c", "twice"]
    assert got.where("twice = 2 * k").count() == got.count() == rows.where("k <> 3").count()
