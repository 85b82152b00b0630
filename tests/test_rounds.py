"""Cases that differed from SQL, or grew too fast, in reviews of this repository."""

from __future__ import annotations

import math
import os
import re
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cadence import session
from cadence.functions import curves, scalars
from cadence.llm import token_files
from cadence.operators import assembly, beats, joins, sequential, windows
from cadence.plans import sequential as plans
from cadence.sources import catalogue, chart_source
from compare import SF


def test_no_candidate_on_a_circle_that_misses_the_field(spark):
    rows = spark.createDataFrame([(1, 700.0), (2, 100.0)], "id long, x double").select("id", F.size(scalars.circle_candidates(F.col("x"), F.lit(100.0), F.lit(90.0), 24, or_corner=False)).alias("n"))
    assert {r.id: r.n for r in rows.collect()} == {1: 0, 2: 24}
    assert spark.sql("SELECT 700D AS x").select(scalars.circle_candidates(F.col("x"), F.lit(100.0), F.lit(90.0), 24).alias("c")).first()["c"] == [(512.0, 384.0)]


def test_halves_of_steps_go_to_even(spark):
    """650,000 * 0.00001 is above 6.5 in binary."""
    halves = [50_000 + 100_000 * k for k in range(40)]
    times = [(0, 0), *((i + 1, sum(x + 1000 for x in halves[: i + 1])) for i in range(len(halves)))]
    rows = spark.createDataFrame([(1, *t) for t in times], "k long, i long, t long")
    got = rows.select("i", windows.delta_step(F.col("t"), windows.ordered("k", "t"), 1000, 0.00001, 500).alias("step")).orderBy("i").collect()
    assert [r.step for r in got] == [0, *(k + k % 2 for k in range(40))]


def test_votes_between_equal_means_go_as_in_sql(spark):
    """At beat 5 the phases 0 and 2 have the mean 58.418; summed from the first beat to the last the third was above."""
    score = [7.26, 48.43, 6.26, 37.89, 86.38, 82.83, 101.18, 16.48, 25.02, 65.83, 70.67, 74.81, 25.28, 37.38, 53.87, 93.36, 15.88, 57.62, 20.96, 69.55, 86.23, 13.72, 1.35, 93.28, 2.8, 5.02, 7.86, 53.32, 52.76, 85.31, 79.73, 142.17, 6.71, 16.52, 150.7, 6.21, 79.39, 8.06, 95.05, 8.79, 5.5, 31.77, 204.86, 28.83, 11.98, 11.88, 42.24, 62.18, 5.36]
    red = (4, 6, 9, 11, 13, 21, 24, 28, 37)
    rows = spark.createDataFrame([(1, i, x, i in red) for i, x in enumerate(score)], "track long, seq long, score double, is_red boolean")
    got = {r.seq: r.measure for r in sequential.measure_votes(rows, 4).collect()}
    assert got[5] and not got[7]


def test_peak_beside_the_first_sample_of_a_track():
    """73.08 - (73.08 - 13.44) is below 13.44: at such a height nothing was found on the left."""
    found = beats.peaks(np.array([0, 1]), np.array([13.44, 73.08]), 3, 1.0, 12)
    assert found["place"].tolist() == [1] and found["width"].tolist() == [2 - 13.44 / 73.08]


def test_width_at_a_foot_above_zero():
    found = beats.peaks(np.array([4, 5, 6, 7, 8]), np.array([90.0, 13.44, 73.08, 13.44, 5.0]), 2, 1.0, 12)
    assert found.set_index("place").loc[6, "width"] == 2.0


def _hourly(path, rows):
    """A folder with events of user 1: (event_id, hour, value)."""
    values = ", ".join(f"({i}, {hour}, {value}::DOUBLE)" for i, hour, value in rows)
    duckdb.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(h) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, v AS value FROM (VALUES {values}) AS t(i, h, v)) TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


def test_width_halfway_between_two_roundings(spark, tmp_path):
    """674 - 670 - 20.83 / 32 is 3.3490625, in binary a bit less, and the sixth place was rounded down."""
    rows = [(669, 252.43), (670, 12.67), (671, 6.44), (671, 38.23), (672, 46.52), (672, 43.81), (673, 51.1), (674, 33.5), (675, 51.61), (676, 67.63), (677, 314.06)]
    path = _hourly(tmp_path, [(i, *row) for i, row in enumerate(rows)])
    got = queries()["wide_peaks"](spark, path).toPandas()
    assert got.loc[got["place"] == 672, "width"].tolist() == [3.349063]


def test_hourly_sums_follow_the_order_of_events(spark, tmp_path):
    path = _hourly(tmp_path, [(1, 5, 0.2), (2, 5, 0.3), (0, 5, 0.1), (3, 6, 7.0)])
    got = {r.place: r.value for r in plans._signal(spark, path).collect()}
    assert got == {5: 0.1 + 0.2 + 0.3, 6: 7.0} and got[5] != 0.2 + 0.3 + 0.1


def test_points_along_an_axis_are_whole():
    for length in range(31, 140):
        assert curves.at_length(np.array([[22.0, 7.0], [52.0, 7.0]]), float(length)).tolist() == [22 + length, 7]


def test_the_lookahead_begins_where_its_share_says(spark):
    """(1 - 0.3) * 86400 is below 60480 in binary; a time shift to 60,470 ms is before the lookahead, one to 60,480 at its start."""
    rows = spark.createDataFrame([(1, 0, 1, "circle", 1), (1, 0, 2, "time_shift", 6047), (1, 1, 1, "circle", 1), (1, 1, 2, "time_shift", 6048), (1, 1, 3, "circle", 2), (1, 2, 1, "circle", 3)], "k long, window long, seq long, kind string, value long")
    got = windows.trimmed_windows(rows, "k", 10, 60_000, 86_400, 0.1, 0.3)
    assert sorted((r.window, r.seq) for r in got.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 1)]


@pytest.mark.parametrize("sign", [1, -1])
def test_neighbours_of_many_queries_take_bounded_memory(sign):
    """Before anything is known, 300 queries and 2,048 rows were 600,000 pairs of vectors at once, about 900 MB."""
    rng = np.random.default_rng(4)
    queries, rows = rng.normal(size=(300, 64)), rng.normal(size=(2048, 64))
    found = joins._Best(np.arange(300), queries, 3, sign, None)
    tracemalloc.start()
    found.add(np.arange(2048) + 150, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    for q in (0, 149, 150, 299):
        far = [(sign * math.dist(queries[q], rows[r]), r + 150) for r in range(2048) if r + 150 != q]
        assert found.id[q].tolist() == [i for _, i in sorted(far)[:3]]


@pytest.mark.parametrize("sign", [1, -1])
def test_memory_of_neighbours_does_not_grow_with_queries_or_copies(sign):
    """Rows are copies of three vectors, so all that tie with the best must be worked out."""
    rng, peaks = np.random.default_rng(6), []
    rows = rng.normal(size=(3, 64))[np.arange(2048) % 3]
    for n in (600, 2400):
        found = joins._Best(np.arange(n) + 10_000, rng.normal(size=(n, 64)), 3, sign, None)
        tracemalloc.start()
        found.add(np.arange(2048), rows)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        for q in (0, n - 1):
            best = min(range(3), key=lambda r: sign * math.dist(found.vectors[q], rows[r]))
            assert found.id[q].tolist() == [best, best + 3, best + 6]
    assert peaks[1] < 1.1 * peaks[0] < 150 << 20


@pytest.mark.parametrize("sign", [1, -1])
def test_neighbours_among_copies_in_small_blocks(sign, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 50)
    monkeypatch.setattr(joins, "NUMBERS", 14)
    rng = np.random.default_rng(5)
    queries, rows = rng.integers(0, 3, (9, 2)).astype(float), rng.integers(0, 3, (60, 2)).astype(float)
    found = joins._Best(np.arange(9), queries, 4, sign, None)
    for start in range(0, 60, 20):
        found.add(np.arange(start, start + 20), rows[start : start + 20])
    for q in range(9):
        far = [(sign * math.dist(queries[q], rows[r]), r) for r in range(60) if r != q]
        assert found.id[q].tolist() == [i for _, i in sorted(far)[:4]]


def _folders(spark, query, name):
    """How many folders and files a query leaves in working folders of a name."""
    seen = len(session._MADE)
    queries()[query](spark, SF).count()
    path = next(p for p in session._MADE[seen:] if f"/{name}-" in p).removeprefix("file://")
    return sum(len(d) for _, d, _ in os.walk(path)), sum(len(f) for _, _, f in os.walk(path))


def test_charts_of_a_partition_share_a_folder(spark):
    folders, files = _folders(spark, "chart_round_trip", "charts")
    assert folders < files / 2


def test_logs_of_a_partition_share_a_folder(spark):
    folders, files = _folders(spark, "metric_logs", "logs")
    assert folders < files / 2


def test_plain_lines_know_no_sections(spark, tmp_path):
    (tmp_path / "1.log").write_text("[a]\nFID: 1\n[a]\n\n// FID: 2\nFID: 3")
    lines = chart_source.read_charts(spark, str(tmp_path), suffix=".log", plain="true")
    assert [(r.section, r.line, r.text) for r in lines.orderBy("line").collect()] == [(None, 0, "[a]"), (None, 1, "FID: 1"), (None, 2, "[a]"), (None, 3, ""), (None, 4, "// FID: 2"), (None, 5, "FID: 3")]
    found = catalogue.metric_lines(lines, ["FID"]).orderBy("line")
    assert [(r.line, r.value) for r in found.collect()] == [(1, 1.0), (5, 3.0)]


def test_tasks_of_hit_objects_go_by_groups(spark, monkeypatch):
    monkeypatch.setattr(assembly, "GROUPS", 10)
    rows = [(i % 9, i, "circle", i * 10, 1.0, 2.0, False, 0, 0, 0) for i in range(95)]
    lines = assembly.hit_object_lines(spark.createDataFrame(rows, "chart long, seq long, type string, time long, x double, y double, new_combo boolean, hitsound int, sample_set int, addition int"))
    assert re.search(r"hashpartitioning\(chart#\d+L?, 10\), REPARTITION_BY_NUM", lines._jdf.queryExecution().executedPlan().toString())
    assert lines.count() == 95


def test_texts_are_encoded_in_small_parts():
    parts = list(token_files._in_parts(["x" * 100_000] * 20))
    assert max(sum(map(len, p)) for p in parts) <= 500_000 and sum(parts, []) == ["x" * 100_000] * 20
