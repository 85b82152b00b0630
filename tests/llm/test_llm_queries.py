import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from compare import SF, assert_same, connection

from cadence.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_duckdb(spark, name):
    assert_same(queries.QUERIES[name](spark, SF).toPandas(), connection().sql(queries.ORACLES[name]).df())
