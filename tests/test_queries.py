import pytest

from quern.plans import registry
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, data, name):
    same(spark, con, data, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.count() > 0 and df.columns


def test_entry():
    import __spark_entry__ as e

    assert "q30_reconcile" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
