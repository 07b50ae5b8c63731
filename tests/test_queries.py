"""Every registered query against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks.verify import compare, connect, type_differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["destination_id", "records", "bytes"] and df.count() == 3


def test_each_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    assert compare(df, con, sql) is None if sql else df.collect() is not None


def test_types_are_compared(spark, con):
    df = spark.sql("select 1 as a")
    assert type_differences(df, con, "select cast(1 as bigint) as a") == [("a", "int", "BIGINT")]
