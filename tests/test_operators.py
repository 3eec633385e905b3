"""Operators against brute force on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import backtest as bt
from tideline.operators import cleaning as cl
from tideline.operators import forecasting as fc
from tideline.operators import joins as jn
from tideline.operators import selection as sel
from tideline.operators import splits as sp
from tideline.operators import trials as tr
from tideline.operators.ordered import time_bucket


def stamped(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec"))


@pytest.mark.parametrize("bucket", [None, 5000])
def test_asof_equals_pandas(spark, bucket):
    rng = np.random.RandomState(5)
    left = pd.DataFrame({"series_key": rng.choice(["a", "b"], 300), "sec": rng.randint(0, 50000, 300)}).drop_duplicates()
    left["v"] = range(len(left))
    right = pd.DataFrame({"series_key": rng.choice(["a", "b"], 60), "sec": rng.randint(0, 50000, 60), "seq": range(60)})
    right["v"] = rng.normal(size=60)
    right.loc[::7, "v"] = None
    b = time_bucket(bucket) if bucket else None
    from tideline.functions.nulls import nan_to_null

    got = jn.asof_join(stamped(spark, left), nan_to_null(stamped(spark, right)).drop("sec"), bucket=b).select("v", "v_right").toPandas().set_index("v")["v_right"]
    want = pd.merge_asof(left.sort_values("sec"), right.sort_values(["sec", "seq"]), on="sec", by="series_key", suffixes=("", "_right")).set_index("v")["v_right"]
    assert np.allclose(got.sort_index().astype(float), want.sort_index().astype(float), equal_nan=True)


def test_ranges_meet_only_their_rows(spark):
    df = spark.range(1000).select(F.lit("s").alias("series_key"), F.col("id").alias("rn"))
    ranges = spark.createDataFrame([("s", 0, 0, 10), ("s", 1, 5, 700), ("s", 2, 999, 2000)], "series_key string, fold int, lo bigint, hi bigint")
    n = {r["fold"]: r["count"] for r in jn.rows_in_ranges(df, ranges, "rn", width=64).groupBy("fold").count().collect()}
    assert n == {0: 10, 1: 695, 2: 1}


def sequential(prices, signals, fee):
    cash, held, equity, trades = 1000.0, 0.0, [], 0
    for p, s in zip(prices, signals):
        if s == 1 and cash > 0:
            held, cash, trades = cash * (1 - fee) / p, 0.0, trades + 1
        elif s == -1 and held > 0:
            cash, held, trades = held * p * (1 - fee), 0.0, trades + 1
        equity.append(cash + held * p)
    return equity, trades


@pytest.mark.parametrize("seed,bucket", [(0, None), (1, None), (2, 3000), (3, 500)])
def test_backtest_equals_a_loop(spark, seed, bucket):
    rng = np.random.RandomState(seed)
    p, s = 100 * np.cumprod(1 + rng.normal(0, 0.02, 400)), rng.choice([-1, 0, 1], 400, p=[0.1, 0.8, 0.1])
    df = stamped(spark, pd.DataFrame({"model": "m", "series_key": "s", "sec": np.arange(400) * 60, "close": p, "signal": s}))
    t = bt.backtest(df, fee=0.001, bucket=time_bucket(bucket) if bucket else None)
    want, trades = sequential(p, s, 0.001)
    assert np.allclose(t.orderBy("ts").toPandas()["equity"], want, rtol=1e-11)
    m = bt.backtest_metrics(t).first()
    eq = pd.Series(want)
    r = eq.pct_change().fillna(0)
    assert m["num_trades"] == trades and m["final_equity"] == pytest.approx(want[-1])
    assert m["sharpe"] == pytest.approx(r.mean() / r.std() * np.sqrt(252)) and m["max_drawdown"] == pytest.approx((eq / eq.cummax() - 1).min())


def test_folds_never_overlap_and_stay_inside(spark):
    lengths = spark.createDataFrame([("a", 1000), ("b", 520), ("c", 90), ("d", 1)], "series_key string, n bigint")
    tables = [
        sp.expanding_folds(lengths, 400, 50, 10, 100, 50, 3), sp.blocked_folds(lengths, 200, 50, 3),
        sp.purged_folds(lengths, 400, 50, 100, 50, 3, 10, 5), sp.walk_forward_windows(lengths, 300, 100, 24),
    ]
    for folds in tables:
        assert folds.where("lo < 0 OR hi <= lo").count() == 0
        assert folds.join(lengths, "series_key").where("hi > n").count() == 0
    for folds in tables[:3]:
        assert sp.leakage_check(folds).where("overlaps = 1").count() == 0


def test_corr_matrix_is_pairwise_complete(spark):
    rng = np.random.RandomState(2)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (500, 4)), columns=list("abcd"))
    pdf["b"] += pdf["a"]
    pdf["e"] = 3.0
    pdf.loc[::5, "c"] = np.nan
    from tideline.functions.nulls import nan_to_null

    df = nan_to_null(spark.createDataFrame(pdf)).repartition(4)
    want = pdf.corr()
    for r in sel.corr_matrix(df, list("abcde")).collect():
        w = want.loc[r["left_column"], r["right_column"]]
        assert (r["r"] is None and np.isnan(w)) or r["r"] == pytest.approx(w, abs=1e-9)
    assert all(r["abs_r"] is None or r["abs_r"] <= 1 for r in sel.target_corr(df, list("abce"), "d").collect())


def _greedy(strength, matrix, threshold):
    kept = []
    for f in sorted(strength, key=lambda n: (-(strength[n] or 0.0), n)):
        if not any(abs(matrix.get((f, k), matrix.get((k, f))) or 0.0) > threshold for k in kept):
            kept.append(f)
    return set(kept)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_selection_equals_its_loop(spark, seed):
    """Chains of correlated features, equal strengths, pairs without a figure; one plan without a job of its own."""
    rng = np.random.RandomState(seed)
    names = [f"f{i}" for i in range(3 + 4 * seed)]
    strength = {n: None if rng.rand() < 0.1 else float(rng.choice([0.2, 0.5, rng.rand()])) for n in names}
    matrix = {(a, b): None if rng.rand() < 0.1 else float(rng.uniform(-1, 1)) for i, a in enumerate(names) for b in names[i + 1 :]}
    s = spark.createDataFrame(list(strength.items()), "feature string, abs_r double")
    m = spark.createDataFrame([(a, b, r) for (a, b), r in matrix.items()], "left_column string, right_column string, r double")
    assert {r["feature"] for r in sel.drop_collinear(s, m, 0.5).collect()} == _greedy(strength, matrix, 0.5)


@pytest.mark.parametrize("mode,y_low", [("strict", True), ("strict", False), ("reference", True)])
def test_front_equals_pairwise_rule(spark, mode, y_low):
    rng = np.random.RandomState(9)
    pts = pd.DataFrame({"study": "s", "trial_id": range(200), "x": rng.randint(0, 30, 200) / 10, "y": rng.randint(0, 30, 200) / 10})
    got = {r["trial_id"] for r in tr.pareto_front(spark.createDataFrame(pts), "x", "y", y_low=y_low, mode=mode).collect()}
    sign = 1 if y_low else -1
    want = set()
    for i, a in pts.iterrows():
        beaten = False
        for j, b in pts.iterrows():
            if i == j or b.x > a.x or sign * b.y > sign * a.y:
                continue
            beaten = beaten or mode == "reference" or b.x < a.x or sign * b.y < sign * a.y
        if not beaten:
            want.add(a.trial_id)
    assert got == want


def test_isolation_forest_finds_planted_outliers(spark):
    from tideline.operators.isolation import isolation_flag

    rng = np.random.RandomState(4)
    x = rng.normal(0, 1, (2000, 2))
    x[:20] += 12
    df = spark.createDataFrame(pd.DataFrame({"id": range(2000), "a": x[:, 0], "b": x[:, 1]}))
    out = isolation_flag(df, ["a", "b"], ["id"], trees=30, sample=128)
    assert out.where("id < 20 AND is_outlier = 1").count() == 20
    assert 100 <= out.where("is_outlier = 1").count() <= 200


def test_grid_weights_sum_to_one(spark):
    g = fc.simplex_grid(spark, 3).toPandas()
    assert len(g) == 66 and np.allclose(g.sum(axis=1), 1)
    d = fc.dirichlet_draws(spark, 5, 50).toPandas()
    assert len(d) == 50 and np.allclose(d.sum(axis=1), 1)


def test_row_order_does_not_matter(spark):
    rng = np.random.RandomState(8)
    pdf = pd.DataFrame({"series_key": "s", "sec": np.arange(60) * 3600, **{c: rng.uniform(90, 110, 60) for c in ("open", "high", "low", "close", "volume")}})
    a = cl.clean_bars(stamped(spark, pdf)).orderBy("ts").toPandas()
    b = cl.clean_bars(stamped(spark, pdf.sample(frac=1, random_state=1))).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_rows_of_bad_input_are_refused(spark):
    from tideline.operators.bars import duration, require_bar_columns
    from tideline.sources.readers import scan_any

    with pytest.raises(ValueError):
        require_bar_columns(spark.range(1).withColumnRenamed("id", "close"))
    with pytest.raises(ValueError):
        scan_any(spark, "/tmp/x.xlsx")
    with pytest.raises(ValueError):
        duration("7min")


def test_equal_results_from_seeded_draws(spark):
    from tideline.plans.trials import SPACE

    rows = spark.range(500).withColumnRenamed("id", "k")
    a = tr.random_params(rows, "k", SPACE).orderBy("k").toPandas()
    b = tr.random_params(rows.repartition(3), "k", SPACE).orderBy("k").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert (a["stride"] <= a["patch_len"]).all() and (a["d_model"] % a["n_heads"] == 0).all()
    assert (a["label_len"] <= 48).all() and a["rate"].between(1e-5, 1e-2).all()


def test_enhance_leaves_complete_consistent_rows(spark):
    rows = [("a", i, i, 10.0 + i % 3, 9.0 if i % 11 == 0 else 12.0 + i % 3, 8.0, None if i % 7 == 0 else 10.0 + i % 2, -5.0 if i % 13 == 0 else 100.0, None if i % 5 == 0 else float(i)) for i in range(120)]
    rows += [("a", 5, 500, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series_key string, day int, seq int, open double, high double, low double, close double, volume double, rate double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("day").cast("long") * 86400)).drop("day")
    out = cl.enhance(df, "2000-01-01", ["rate"], flagged=F.col("seq") == 3).toPandas()
    assert len(out) == 120 and not out[["open", "high", "low", "close", "volume", "rate"]].isna().any().any()
    assert (out.high >= out[["open", "close"]].max(axis=1)).all() and (out.volume >= 0).all() and (out.missing_data_ratio == 0).all()


def test_more_windows_than_fifty(spark):
    lengths = spark.createDataFrame([("long", 2400), ("short", 259), ("exact", 260)], "series_key string, n int")
    out = sp.walk_forward_windows(lengths, 200, 60, 24).toPandas()
    assert (out[out.series_key == "long"].fold.nunique(), out[out.series_key == "exact"].fold.nunique()) == (90, 1) and "short" not in set(out.series_key)
    assert sp.walk_forward_windows(lengths, 200, 60, 24, most=3).toPandas().fold.max() == 2


def test_signals_side_by_side_equal_one_backtest_each(spark):
    rows = [("m", k, i, 100.0 + (i * 37 + k * 11) % 23, (i * (k + 3)) % 5 - 2, (i * 7) % 3 - 1) for k in range(3) for i in range(40)]
    d = spark.createDataFrame(rows, "model string, series_key int, ts int, close double, a int, b int")
    both = bt.backtests(d, {"a": F.col("a"), "b": F.col("b")}, [0.0, 0.002])
    got = {(r["strategy"], r["fee"], r["series_key"]): r.asDict() for r in both.collect()}
    assert len(got) == 12
    for s in ("a", "b"):
        for fee in (0.0, 0.002):
            for r in bt.backtest_metrics(bt.backtest(d.withColumn("signal", F.col(s)), fee=fee)).collect():
                other = got[s, fee, r["series_key"]]
                assert all(other[c] == pytest.approx(x, rel=1e-9, abs=1e-12) for c, x in r.asDict().items() if c != "model")


def test_rankings_of_a_sweep_read_it_once(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        runs.add(1)
        return x

    d = spark.createDataFrame([("m", k, 0.0, 0.0, 0.0, k / 7, -0.5, k % 3 / 2) for k in range(20)], "model string, series_key int, confidence double, fee double, change double, total_return double, max_drawdown double, sharpe double")
    top = bt.top_k_sweep(d.withColumn("sharpe", counted("sharpe")), k=3).collect()
    assert len(top) == 9 and runs.value == 20
    assert [r["series_key"] for r in top if r["ranking"] == "return"] == [19, 18, 17]
    assert [r["series_key"] for r in top if r["ranking"] == "sharpe"] == [2, 5, 8]


def test_equal_lags_rank_by_lag_whatever_their_last_bits(spark):
    from tideline.operators.regimes import autocorr_top_lags

    x = np.floor(np.random.default_rng(574).uniform(1e4, 1e7, 96)) / 100
    d = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    assert [t["lag"] for t in autocorr_top_lags(d, "x", digits=2).first()["top_lags"]] == [0, 8, 88, 34, 62]


def test_quantile_bins_count_the_cut_points_reached(spark):
    """Ties, NULLs, a column of one value and one without any; rows are binned without a function on arrays."""
    import numpy as np

    from tideline.operators.selection import quantile_bins

    x = [float(i % 7) if i % 5 else None for i in range(60)]
    df = spark.createDataFrame([(i, v, 3.0, None) for i, v in enumerate(x)], "id int, a double, one double, none double")
    out = quantile_bins(df, ["a", "one", "none"], 4)
    cuts = np.unique(np.quantile([v for v in x if v is not None], [0.25, 0.5, 0.75]))
    want = [(i, None if v is None else int((cuts <= v).sum()), 1, None) for i, v in enumerate(x)]
    assert sorted(map(tuple, out.collect())) == want
    assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()


def test_forest_walks_as_node_by_node():
    import numpy as np
    import pandas as pd

    from tideline.operators import isolation

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.lognormal(size=(5000, 3)), np.zeros((4, 3))])
    trees = []
    for _ in range(7):
        nodes = []
        isolation._grow(x[rng.choice(len(x), 64)], 0, 6, rng, nodes)
        trees.append(pd.DataFrame(nodes, columns=["col", "cut", "left", "right", "depth"]))

    def depth(t, row):
        node = t.iloc[0]
        while node.col >= 0:
            node = t.iloc[int(node.left if row[int(node.col)] < node.cut else node.right)]
        return node.depth

    got = isolation._Forest(trees).mean_depths(x)
    assert np.allclose([got[i] for i in (0, 4097, 5003)], [np.mean([depth(t, x[i]) for t in trees]) for i in (0, 4097, 5003)])


def test_quantiles_of_few_keys_move_no_rows(spark):
    """Ten columns are ten keys: their rows must not meet in ten tasks."""
    from tideline.operators.ordered import exact_quantiles

    df = spark.range(20_000).selectExpr("id % 2 AS k", "CAST(id * 7919 % 20011 AS DOUBLE) AS x")
    few, many = (exact_quantiles(df, ["k"], "x", [0.1, 0.5], accuracy=1000, few_keys=f) for f in (True, False))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    text = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
