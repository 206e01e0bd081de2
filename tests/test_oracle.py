import pytest
from oracle import DATA, compare, connect

from skerry.plans.registry import core_queries, core_sql

QUERIES, SQL = core_queries(), core_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, DATA).collect()
