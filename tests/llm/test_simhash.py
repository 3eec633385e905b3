import random

import numpy as np
import pytest
import xxhash

from tideline.llm import simhash
from tideline.llm.components import components


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == classes(real, {x for e in real for x in e})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("tile", [2048, 7])
def test_links_lose_nothing(spark, monkeypatch, tile):
    """Against all pairs, with many fingerprints under one value; small tiles force tile pairs."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(48, rng.integers(0, 5), replace=False)) for b in base for _ in range(12)]
    low = [int(x) for x in rng.integers(0, 1 << 20, 150)]  # the same value in most blocks
    values = sorted({*near, *low, 0, -1, -2, -(1 << 63)})
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    pairs = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    u = np.array(values, np.int64).view(np.uint64)
    true = [(values[i], values[j]) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(u[i] ^ u) <= 3) if j > i]
    assert {tuple(sorted(p)) for p in pairs} <= set(true)
    assert classes(pairs, values) == classes(true, values)


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out - (1 << 64) if out >> 63 else out


def test_odd_rows(spark, frame, odd):
    got = simhash.near_duplicates(frame(odd)).collect()
    assert len(got) == len(odd)
    assert sorted(str((r["doc_id"], r["fp"])) for r in got) == sorted(str((i, plain_fingerprint(t))) for i, t, _, _ in odd)
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert of[7] == 6 and of[1] == of[2] == of[3] == 1
    assert simhash.near_duplicates(frame([])).count() == 0


def test_one_of_each_group_catches_near_copies_and_leaves_others(spark, frame):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, copies = [], 0
    for i in range(150):
        base = [word() for _ in range(300)]
        rows.append((10 * i, " ".join(base), "en", "a"))
        if i % 3 == 0:
            near = list(base)
            for k in rng.sample(range(300), 4):
                near[k] = word()
            rows += [(10 * i + 1, " ".join(near), "en", "a"), (10 * i + 2, " ".join(base), "en", "b")]
            copies += 2
    kept = simhash.one_of_each_group(frame(rows))
    assert {r["doc_id"] for r in kept.collect()} == {10 * i for i in range(150)}
    assert kept.columns == frame([]).columns


def test_one_of_each_group_with_odd_rows(spark, frame, odd):
    ids = [r["doc_id"] for r in simhash.one_of_each_group(frame(odd)).collect()]
    assert sorted(ids) == [1, 4, 5, 6, 6, 8, 9, 10]
    assert simhash.one_of_each_group(frame([])).count() == 0


def test_one_of_each_group_counts_repeated_lines_once(spark, frame):
    """A line repeated many times neither links texts with nothing else in common nor parts texts of the same shingles."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = prose(16)
    loop = "\n".join([line] * 2)
    apart = [(i, prose(304) + "\n" + "\n".join([line] * 50), "en", "a") for i in range(6)]
    text = prose(300)
    same = [(10, text + "\n" + loop, "en", "a"), (11, text + "\n" + "\n".join([line] * 50), "en", "a")]
    assert sorted(r["doc_id"] for r in simhash.one_of_each_group(frame(apart + same)).collect()) == [0, 1, 2, 3, 4, 5, 10]


def test_one_of_each_group_equals_exact_jaccard(spark, frame, monkeypatch):
    """Pairs and chains from 0.6 to 0.95, against groups by the exact similarity of all pairs; tiles of both kinds."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for family in range(40):
        base = [word() for _ in range(200)]
        for _ in range(6):
            texts.append(" ".join(base))
            for k in rng.sample(range(200), 1 + family % 10):
                base[k] = word()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = set(classes(pairs, range(len(texts))).values())
    assert 40 < len(want) < 240
    docs = frame([(i, t, "en", "a") for i, t in enumerate(texts)])
    assert {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()} == want
    monkeypatch.setattr(simhash, "TILE", 3)
    assert {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()} == want
