"""The queries of this subpackage that SQL can express, against DuckDB."""

import pytest

from plait.llm.queries import QUERIES, SQL
from tests.oracle import connect, problems


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    problem, _ = problems(spark, connect(sf), QUERIES[name], SQL[name], sf)
    assert problem is None, problem
