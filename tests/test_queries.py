import pytest
from compare import SF, assert_same, connection

from cadence.plans import registry


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_duckdb(spark, duck, name):
    assert_same(registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_is_repeatable(spark, name):
    first, second = (registry.QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(first) > 0
    assert_same(first, second)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
