import pytest

from quern.llm import queries
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, connect(data), data, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0
