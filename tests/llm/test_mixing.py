import random
import re

from pyspark.sql import functions as F

from tideline.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight; what is over a limit goes to the others until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: most * sizes[s] for s in full} | {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if out[s] >= most * sizes[s]}
        if not over or len(over) == len(open_):
            return {s: min(out[s], most * sizes[s]) for s in names}
        full |= over


def texts(n, seed, hot="a"):
    rng = random.Random(seed)
    sources = [hot, hot, hot, "b", "c", "Z", "é", None, "🎈", "￮"]
    return [(i, " ".join(["w"] * int(rng.paretovariate(1.2) * 20 % 3000)), "en", rng.choice(sources)) for i in range(n)]


def test_targets_and_words_taken(spark, frame):
    rows = texts(3000, 1)
    out = mixing.mix(frame(rows)).toPandas()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = brute_targets(sizes)
    for source, g in out.groupby(out.source.where(out.source.notna(), None), dropna=False):
        source = None if source != source else source
        assert abs(g.target.iloc[0] - want[source]) < 1e-6 * max(want[source], 1)
        assert abs((g["size"] * g.copies).sum() - want[source]) <= max(20, 0.002 * want[source])
    assert out.copies.max() <= 2 and (out.copies[out["size"] == 0] == 0).all()


def test_reruns_agree_and_inclusion_follows_the_rate(spark, frame):
    rows = [(i, " ".join(["w"] * (5 + i % 40)), "en", "abc"[i % 3]) for i in range(2400)]
    docs = frame(rows)
    a, b = (sorted(map(tuple, mixing.mix(docs.repartition(n)).select("doc_id", "copies").collect())) for n in (3, 11))
    assert a == b
    other = sorted(map(tuple, mixing.mix(docs, seed=12).select("doc_id", "copies").collect()))
    assert a != other
    share = mixing.mix(docs).groupBy("source").agg((F.sum("copies") / F.count("*")).alias("s"), F.first(F.col("target") / F.col("source_size")).alias("r")).collect()
    assert all(abs(r["s"] - r["r"]) < 0.05 for r in share)


def test_odd_rows_and_empty_table(spark, frame, odd):
    out = mixing.mix(frame(odd)).collect()
    assert len(out) == len(odd) and {r["source"] for r in out} == {None, "a", "b", "c"}
    kept = mixing.taken(frame(odd))
    assert "text" in kept.columns and kept.where("copies < 1").count() == 0
    assert mixing.mix(frame([])).count() == 0 and mixing.taken(frame([])).count() == 0


def test_main_path_is_native(spark, frame):
    assert "Python" not in mixing.mix(frame([(1, "a b", "en", "a")]))._jdf.queryExecution().executedPlan().toString()
