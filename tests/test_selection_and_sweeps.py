"""Selection without sorting, interval containment by a sweep, exact neighbours by blocks of matrices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import aggregates, joins, ranking, selection

SHAPES = {
    "alike": lambda r: 7.0,
    "few": lambda r: float(r.randrange(3)),
    "wide": lambda r: r.choice([-1, 1]) * 10.0 ** r.randrange(-300, 300),
    "spike": lambda r: 1.0 if r.random() < 0.9 else r.random() * 1e9,
    "ends": lambda r: r.choice([float("inf"), float("-inf"), float("nan"), -0.5, 1.7e308, -1.7e308, 0.25]),
}


def in_order(values):
    return sorted(values, key=lambda v: (math.isnan(v), v))


@pytest.mark.parametrize("shape", SHAPES)
def test_selection_against_sorting(spark, shape):
    rng = random.Random(1)
    rows = [(k, SHAPES[shape](rng)) for k in (1, 2, None) for _ in range(400)] + [(1, None), (5, 3.0)]
    wanted = [(k, q, place) for k in (1, None) for q, place in enumerate([0, 1, 37, 200, 399])] + [(2, 0, 400), (2, 1, -1), (3, 0, 0), (5, 0, 0)]
    df = spark.createDataFrame(rows, "key long, value double")
    found = selection.selected(df, spark.createDataFrame(wanted, "key long, q long, place long"), few=20)
    got = {(r.key, r.q): repr(r.value) for r in found.collect()}
    want = {(k, q): repr(in_order([v for j, v in rows if j == k and v is not None])[place]) for k, q, place in wanted if k != 2 and k != 3}
    assert got == want


def test_selection_of_whole_numbers_beyond_doubles(spark):
    values = [2**60 + i for i in range(100)] + [-(2**62), 2**62]
    df = spark.createDataFrame([(0, v) for v in values], "key int, value long")
    wanted = spark.createDataFrame([(0, i, i) for i in (0, 1, 50, 100, 101)], "key int, q int, place long")
    got = {r.q: r.value for r in selection.selected(df, wanted, few=99).collect()}
    assert got == {i: sorted(values)[i] for i in (0, 1, 50, 100, 101)}


def test_medians_of_frequent_keys_are_selected(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.random()) for _ in range(900)] + [(3, 1.0), (3, 2.0), (4, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    both = [{r.k: r.upper_median for r in aggregates.upper_median(df, "k", "v", few).collect()} for few in (50, 100_000)]
    own = {k: sorted(v for j, v in rows if j == k and v is not None) for k in {r[0] for r in rows}}
    assert both[0] == both[1] == {k: v[len(v) // 2] for k, v in own.items() if v}
    assert ranking.order_statistics(df.limit(0), "v", [0.5]).count() == 0


def test_counts_before(spark):
    rows = [(i, i * 37 % 101, i % 3 == 0) for i in range(300)]
    got = ranking.with_count_before(spark.createDataFrame(rows, "i long, t long, f boolean"), ["t", "i"], "f", "n").collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want, n = {}, 0
    for i, _, f in order:
        want[i], n = n, n + f
    assert {r.i: r.n for r in got} == want


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_containment_against_all_pairs(spark, block):
    rng = random.Random(3)
    points = [(i, rng.choice([1, 1, 2, 3]), rng.randrange(60)) for i in range(150)] + [(900, None, 5), (901, 1, None), (5, 1, 7), (5, 1, 7)]
    spans = [(i, rng.choice([1, 2, 4]), a := rng.randrange(60), a + rng.choice([0, 1, 9, 40])) for i in range(60)]
    spans += [(100, 1, -(10**12), 10**15), (101, 2, 5, 4), (102, None, 0, 99), (103, 1, None, 9), (104, 1, 0, None)]
    p, s = spark.createDataFrame(points, "point long, k long, t long"), spark.createDataFrame(spans, "span long, k long, a long, b long")
    got = joins.containing(p, s, "k", "t", "a", "b", block)
    want = [(i, j, k, t, a, b) for i, k, t in points for j, of, a, b in spans if None not in (k, t, a, b) and k == of and a <= t <= b]
    assert sorted((r.point, r.span, r.k, r.t, r.a, r.b) for r in got.collect()) == sorted(want)
    assert joins.containing(p.limit(0), s, "k", "t", "a", "b").count() == 0 and joins.containing(p, s.limit(0), "k", "t", "a", "b").count() == 0


def test_long_spans_go_to_blocks_of_points_only(spark):
    """A span of a million years over 1,000 points makes one row for each block of points."""
    points = spark.range(1000).select(F.col("id").alias("point"), F.lit(1).alias("k"), (F.col("id") * 1000).alias("t"))
    spans = spark.createDataFrame([(i, 1, -(10**15), 10**15) for i in range(5)] + [(9, 1, 10**13, 10**15)], "span long, k int, a long, b long")
    found = joins.containing(points, spans, "k", "t", "a", "b", 100)
    assert found.count() == 5000
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("nearest", [True, False])
def test_neighbours_against_all_pairs(spark, monkeypatch, nearest):
    monkeypatch.setattr(joins, "ROWS", 16)
    monkeypatch.setattr(joins, "FIRST", 30)
    rng = np.random.default_rng(8)
    vectors = np.round(rng.normal(size=(300, 6)), 1) + np.array([1e4, 0, 0, 0, 0, 0])
    vectors[50:60] = vectors[40]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [1.0]), (None, [0.0] * 6), (1003, [])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([r for r in rows if r[0] % 7 == 5 or r[0] == 40], "id long, v array<double>")
    found = joins.neighbours(queries, df, "id", "v", 4, nearest)
    got = {}
    for r in found.orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.id, round(r.distance, 7)))
    sign = 1 if nearest else -1
    for q, v in ((r[0], r[1]) for r in rows if r[0] % 7 == 5 or r[0] == 40):
        far = sorted((sign * float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q)[:4]
        assert got[q] == [(i, round(sign * d, 7)) for d, i in far]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
    assert joins.neighbours(queries.limit(0), df, "id", "v", 4, nearest).count() == 0
    assert joins.neighbours(queries, df.limit(0), "id", "v", 4, nearest).count() == 0


@pytest.mark.parametrize("partitions", ["3", "16"])
def test_running_totals_of_groups_across_ranges(spark, partitions):
    """A hot group over most ranges, small and null groups, groups that end within a range; null values count nothing."""
    r = random.Random(5)
    rows = [("hot", i, r.randrange(9)) for i in range(3000)] + [(f"g{i % 40:02d}", i, None if i % 7 == 0 else i) for i in range(400)] + [(None, i, 1) for i in range(50)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "g string, seq long, v long").withColumn("extra", F.lit("x")).repartition(7)
        got = ranking.with_running_total(df, "g", ["seq"], F.col("v"), "total").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted, sums = {}, {}
    for g, seq, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        sums[g] = sums.get(g, 0) + (v or 0)
        wanted[g, seq] = sums[g]
    assert {(x.g, x.seq): x.total for x in got} == wanted and len(got) == len(rows)
    assert got[0].__fields__ == ["g", "seq", "v", "extra", "total"]


def test_running_totals_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, seq long, v long")
    assert ranking.with_running_total(df, "g", ["seq"], F.col("v"), "total").count() == 0
