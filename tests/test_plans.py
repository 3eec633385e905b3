"""Shapes of physical plans."""

import re

from pyspark.sql import functions as F

from tideline.operators import indicators as ind
from tideline.operators import joins as jn
from tideline.plans.inputs import bars_d, event_ticks, order_days

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bars_use_hash_aggregation_and_read_few_columns(spark):
    p = plan(bars_d(spark, SF))
    assert "SortAggregate" not in p and p.count("Exchange hashpartitioning") == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)", p).group(1)
    assert "l_tax" not in schema and "l_returnflag" not in schema


def test_all_features_share_one_exchange(spark):
    p = plan(ind.all_features(bars_d(spark, SF)))
    assert p.count("Exchange hashpartitioning") == 2  # bars, then series
    assert len(ind.all_features(bars_d(spark, SF)).columns) == 69  # key, ts, 5 base and 62 derived columns


def test_wide_feature_rows_are_never_sorted(spark):
    sorts = re.findall(r"Sort \[([^\]]*)\]", plan(ind.all_features(bars_d(spark, SF))))
    assert "__block" not in sorts[0] and "__block" in sorts[1]  # the order by blocks is below the features


def test_medians_and_limits_of_a_series_read_rows_once(spark):
    from tideline.operators import cleaning as cl

    b = bars_d(spark, SF)
    for d in (cl.fill_median(b, ["close"]), cl.winsorise(b, ["close"], F.col("volume") > 10)):
        p = plan(d)
        assert "Join" not in p and p.count("FileScan") == 1


def test_unused_features_are_pruned(spark):
    p = plan(ind.all_features(bars_d(spark, SF), drop_incomplete=False).select("series_key", "ts", "sma_5"))
    assert "stddev" not in p and p.count("Window [") == 1


def test_sweeps_and_strategies_sort_rows_once_and_copy_none(spark):
    from tideline.plans import trading

    for df in (trading.swept(spark, SF), trading.results(spark, SF)):
        p = plan(df)
        rows = p[p.index("Window ["):]  # below the aggregate of a group
        assert rows.count("Generate") == 0 and "confidence" not in rows and "strategy" not in rows
        assert len(re.findall(r"Sort \[", rows)) == 2  # series, then models of a series


def test_sources_align_in_one_pass(spark):
    b = bars_d(spark, SF).select("series_key", "ts", "close")
    a = b.where("close > 100").withColumnRenamed("close", "c1")
    c = b.where("close > 200").withColumnRenamed("close", "c2")
    p = plan(jn.align_sources(b, {"a": a, "c": c}))
    assert "CartesianProduct" not in p and "NestedLoop" not in p
    assert len(re.findall(r"Window \[", p)) == 1


def test_date_filter_reaches_the_scan(spark):
    days = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderdate >= timestamp_ntz'2000-01-01'").groupBy("o_orderdate").agg(F.count("*").alias("n"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", plan(days))
    assert "l_comment" not in plan(order_days(spark, SF))


def test_tick_queries_never_window_by_key_alone(spark):
    from tideline.operators.ordered import running, time_bucket

    p = plan(running(event_ticks(spark, SF), ["series_key"], ["seq"], {"s": ("sum", F.col("price"))}, time_bucket(3600)))
    assert re.search(r"Exchange hashpartitioning\(series_key#\d+, __bucket", p)


def test_models_of_a_series_stay_with_it(spark):
    """Bars and series are shuffled once each; strategies of three models shuffle nothing by model and series."""
    from tideline.plans import trading

    for df in (trading.swept(spark, SF), trading.results(spark, SF)):
        p = plan(df)
        assert "hashpartitioning(model" not in p and p.count("Exchange hashpartitioning") == 2


def test_bars_are_dealt_by_their_start_alone(spark):
    p = plan(bars_d(spark, SF))
    assert not re.search(r"hashpartitioning\(series_key#\w+, window#", p)
