"""Physical plans: what must be pushed down and what must not appear."""

import pytest
from compare import SF

from cadence.plans import registry


def plan(spark, name):
    df = registry.QUERIES[name](spark, SF)
    df.collect()
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["band_precision_recall", "asof_back_incl", "asof_fwd_strict", "interval_containment", "merge_streams", "boundary_groups", "dominant_period"])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "catalog_filter")
    assert "PushedFilters: [" in text and "PushedFilters: []" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


@pytest.mark.parametrize("name", ["upper_median", "band_precision_recall", "resnap", "token_encode", "sliding_windows", "beat_grid"])
def test_no_python(spark, name):
    text = plan(spark, name)
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))

