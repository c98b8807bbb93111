"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from sensorlake.queries import batch, oracle, streams
from tests.sql_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert differences(df, connection, entry.oracle_sql()[name])[:3] == []


def test_every_query_of_the_engine_has_sql():
    own = {**batch.QUERIES, **streams.QUERIES}
    assert set(own) == set(oracle.SQL)
    assert set(own) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_one_result_row(spark):
    (row,) = entry.entry(spark).collect()
    assert row["total_records"] > 0
