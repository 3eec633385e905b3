from datetime import UTC, date, datetime, timedelta

import pytest

from tideline.sources import fetch as fe

DAY = timedelta(days=1)


def plan(df):
    return df._jdf.queryExecution().toString()


def service(asked_from, asked_to, name="service"):
    """One row an hour; asking for a slice outside the given days is an error."""

    def fetch_data(start, end):
        if end <= asked_from or start >= asked_to:
            raise AssertionError(f"asked for {start}")
        while start < end:
            yield (start, start.hour)
            start += timedelta(hours=1)

    return fe.SlicedSource(name, "ts timestamp, hour int", fetch_data, datetime(2024, 1, 1), datetime(2024, 3, 1), 2 * DAY)


def at(*parts):
    return datetime(*parts, tzinfo=UTC)


def test_only_slices_of_the_range_are_asked_for(spark):
    source = service(at(2024, 1, 9), at(2024, 1, 15))
    rows = source.fetch(spark, datetime(2024, 1, 10, 5), datetime(2024, 1, 14, 3))
    assert rows.rdd.getNumPartitions() == 3
    got = rows.selectExpr("count(*) AS n", "min(ts) AS a", "max(ts) AS z").first()
    assert got["n"] == 4 * 24 - 2
    assert rows.where("ts < '2024-01-10 05:00:00' OR ts >= '2024-01-14 03:00:00'").count() == 0


def test_whole_and_empty_ranges(spark):
    source = service(at(2024, 1, 1), at(2024, 3, 1), "whole")
    assert source.fetch(spark, datetime(1990, 1, 1), datetime(2030, 1, 1)).count() == 60 * 24
    assert source.fetch(spark, datetime(2024, 1, 5), datetime(2024, 1, 5)).count() == 0
    assert source.fetch(spark, datetime(2025, 1, 1), datetime(2026, 1, 1)).count() == 0
    assert source.fetch(spark, datetime(2024, 2, 1, 0, 30), datetime(2024, 2, 1, 1)).count() == 0


def test_further_comparisons_of_the_time_are_pushed_too(spark):
    source = service(at(2024, 1, 1), at(2024, 1, 3), "further")
    assert source.fetch(spark, datetime(2024, 1, 1), datetime(2024, 3, 1)).where("ts < '2024-01-02 00:00:00'").count() == 24


def test_record_batches(spark):
    import pyarrow as pa

    def fetch_data(start, end):
        yield pa.RecordBatch.from_arrays([pa.array([start], pa.timestamp("us", tz="UTC")), pa.array([1.5])], names=["ts", "value"])

    source = fe.SlicedSource("batches", "ts timestamp, value double", fetch_data, datetime(2024, 1, 1), datetime(2024, 1, 6), DAY)
    assert source.fetch(spark, datetime(2024, 1, 2), datetime(2024, 1, 5)).count() == 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_range_of_files_is_pushed_and_half_open(spark, tmp_path, kind):
    days = spark.createDataFrame([(datetime(2024, 1, d, 0 if kind == "date" else 12), d, "x") for d in range(1, 11)], "t timestamp_ntz, v int, other string")
    days.selectExpr(f"cast(t AS {kind}) AS t", "v", "other").write.parquet(str(tmp_path / "t"))
    source = fe.TableSource(str(tmp_path / "t"), "t", (("twice", "v * 2"),))
    start = datetime(2024, 1, 3, 12)
    rows = source.fetch(spark, start, datetime(2024, 1, 6, 12))
    assert rows.columns == ["ts", "twice"]
    assert sorted(r["twice"] for r in rows.collect()) == ([8, 10, 12] if kind == "date" else [6, 8, 10])
    text = plan(rows)
    assert "GreaterThanOrEqual(t," in text and "LessThan(t," in text and "other" not in text.split("== Physical Plan ==")[1].split("ReadSchema")[1]


def test_all_columns_without_a_list(spark, tmp_path):
    spark.createDataFrame([(date(2024, 1, 2), 1)], "t date, v int").write.parquet(str(tmp_path / "t"))
    assert fe.TableSource(str(tmp_path / "t"), "t").fetch(spark, datetime(2024, 1, 1), datetime(2024, 2, 1)).columns == ["ts", "v"]


def test_datasets_by_name(spark):
    sets = fe.Datasets()

    @sets.register("numbers")
    def numbers(spark, start, end, factor=1):
        return spark.range(3).selectExpr(f"id * {factor} AS v")

    assert sets.names() == ["numbers"]
    assert [r["v"] for r in sets.load(spark, "numbers", datetime(2024, 1, 1), datetime(2024, 1, 2), factor=3).collect()] == [0, 3, 6]
    with pytest.raises(KeyError, match="no dataset other"):
        sets.load(spark, "other", datetime(2024, 1, 1), datetime(2024, 1, 2))
    with pytest.raises(ValueError, match="twice"):
        sets.register("numbers")(numbers)


def test_sources_are_aligned_with_rows_of_a_range(spark):
    left = spark.createDataFrame([("a", datetime(2024, 1, d, 6, 30)) for d in range(1, 20)], "series_key string, ts timestamp")
    out = fe.aligned(spark, left, {"s": service(at(2024, 1, 3), at(2024, 1, 11), "near")}, datetime(2024, 1, 6), datetime(2024, 1, 9), DAY)
    assert sorted((r["ts"].day, r["hour"]) for r in out.collect()) == [(6, 6), (7, 6), (8, 6)]
