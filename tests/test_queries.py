"""Every registered query on the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles as co

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in co.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _ = co.check(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None, problem


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 200


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
