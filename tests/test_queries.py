"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from oracle_check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 9


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, DATA), con, SQL[name]) is None
