"""Every registered query against its SQL twin on the smallest data set."""

import pytest

import __spark_entry__ as entry
from plait.plans import registry
from tests.oracle import connect, problems

QUERIES, SQL = registry()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name not in SQL:
        assert QUERIES[name](spark, sf).count() > 0
        return
    problem, _ = problems(spark, con, QUERIES[name], SQL[name], sf)
    assert problem is None, problem


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "field", "from", "to"]
    assert df.count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
