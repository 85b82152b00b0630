"""Peaks, envelopes, walks, snaps and clusters against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import beats, clusters, sequential


def plain_peaks(dense, distance, prominence, reach, width=0.0, share=1.0):
    """Every sample looked at for every peak."""
    n, tops = len(dense), []
    for i in range(1, n - 1):
        j = i
        while j + 1 < n and dense[j + 1] == dense[i]:
            j += 1
        if dense[i - 1] < dense[i] and j + 1 < n and dense[j + 1] < dense[i]:
            tops.append((i + j) // 2)
    kept = []
    for p in sorted(tops, key=lambda i: (-dense[i], i)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    found = []
    for p in sorted(kept):
        lows = []
        for way in (-1, 1):
            i, low = p, dense[p]
            while 0 <= i < n and dense[i] <= dense[p] and abs(i - p) <= (reach if reach is not None else n):
                low, i = min(low, dense[i]), i + way
            lows.append(low)
        over = dense[p] - max(lows)
        if over < prominence or over <= 0:
            continue
        ends = []
        for way in (-1, 1):
            i, height = p, dense[p] - share * over
            while dense[i] > height:
                i += way
            ends.append(i - way * (height - dense[i]) / (dense[i - way] - dense[i]))
        if ends[1] - ends[0] >= width:
            found.append((p, over, ends[1] - ends[0]))
    return found


@pytest.mark.parametrize("seed", range(60))
def test_peaks_against_every_sample(seed):
    rng = random.Random(seed)
    values = rng.choice([[0, 1, 2], [0, 0, 0, 1, 2, 3, 4], [0.5, 1.25, 3.0, 2.0], list(range(100))])
    dense = [float(rng.choice(values)) for _ in range(rng.randrange(1, 90))] + [0.0]
    rows = [(i, v) for i, v in enumerate(dense[:-1]) if v or rng.random() < 0.3 or i == len(dense) - 2]
    args = rng.choice([1, 2, 5, 9]), rng.choice([0.1, 1.0, 2.0]), rng.choice([None, 1, 3, 8]), rng.choice([0.0, 2.0, 2.5]), rng.choice([1.0, 0.5])
    got = beats.peaks(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), *args)
    want = plain_peaks(dense, *args)
    assert got["place"].tolist() == [w[0] for w in want]
    assert np.allclose(got[["prominence", "width"]].to_numpy(), np.array([w[1:] for w in want]).reshape(-1, 2))


def test_peaks_of_sparse_tracks_over_clusters(spark, monkeypatch):
    """A long track, silent for billions of places, in several groups, is as it is in one."""
    monkeypatch.setattr(clusters, "ROWS", 40)
    rng = random.Random(2)
    rows, at = [], 0
    for _ in range(300):
        at += rng.choice([1, 1, 1, 2, 9, 15, 40])
        rows.append((1, at, float(rng.randrange(1, 9))))
    rows += [(2, 5, 1.0), (2, 5, 2.0), (2, 4_000_000_000, 7.0), (None, 3, 1.0), (3, None, 1.0), (3, 4, None), (4, 0, 9.0), (4, 1, 1.0)]
    df = spark.createDataFrame(rows, "track long, place long, value double")
    got = beats.find_peaks(df, 4, 1.0, 12, 1.0).collect()
    dense = [0.0] * (at + 2)
    for track, place, value in rows:
        if track == 1:
            dense[place] += value
    assert [(r.place, r.prominence, pytest.approx(r.width)) for r in sorted(got, key=lambda r: r.place) if r.track == 1] == plain_peaks(dense, 4, 1.0, 12, 1.0)
    assert sorted((r.track or 0, r.place, r.prominence) for r in got if r.track != 1) == [(0, 3, 1.0), (2, 5, 3.0), (2, 4_000_000_000, 7.0)]
    groups = clusters.clusters(df.where("track = 1"), "track", "place", 14).groupBy("_cluster").count().collect()
    assert len(groups) >= 4 and max(r["count"] for r in groups) < 150
    assert beats.find_peaks(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_envelope_against_all_places(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    place = rng.integers(0, rng.choice([10, 1000]), n).astype(float)
    height = rng.choice([1.0, 2.0, 3.0], n) if seed % 2 else rng.random(n) + 0.01
    times = np.concatenate([rng.integers(-50, 1100, 200).astype(float), place, place + 0.5])
    got = beats.Envelope(place, height).nearest(times)
    loss = np.abs(place[None, :] - times[:, None]) / height
    least = loss.min(axis=1)
    assert np.allclose(loss[np.arange(len(times)), got], least, rtol=1e-12, atol=1e-12)
    assert len(beats.Envelope(place, height).owner) <= 2 * n


def test_nearest_of_a_track_with_very_many_queries(spark, monkeypatch):
    monkeypatch.setattr(beats, "QUERIES", 100)
    rng = random.Random(1)
    peaks = [(t, rng.randrange(5000), rng.random() + 0.1) for t in (1, 2) for _ in range(30)] + [(3, 1, 1.0), (1, 7, 0.0), (1, None, 1.0)]
    queries = [(1, i, rng.randrange(5000)) for i in range(950)] + [(2, 2000 + i, rng.randrange(5000)) for i in range(20)] + [(4, 5000, 1), (1, 5001, None)]
    q, p = spark.createDataFrame(queries, "track long, id long, time_ms long"), spark.createDataFrame(peaks, "track long, place long, prominence double")
    got = {r.id: (r.track, r.place) for r in beats.nearest_by_loss(q, p).collect()}
    want = {i: (track, min((abs(at - t) / h, at) for k, at, h in peaks if k == track and h > 0 and at is not None)[1]) for track, i, t in queries if track in (1, 2) and t is not None}
    assert got == want and beats.nearest_by_loss(q, p.limit(0)).count() == 0


def plain_walk(rows, near, doubtful, margin):
    peaks, length = sorted(r for r in rows if r[1] > 0), max(r[4] for r in rows)
    found, out = [], set()
    for place, _, period, _, _ in sorted(peaks, key=lambda r: (-r[1], r[0])):
        if any(a <= place <= b for a, b in found):
            continue
        out.add(place)
        ends = []
        for way in (1, -1):
            at, step = place, period
            while True:
                want = at + way * step
                best = min(peaks, key=lambda r: (abs(r[0] - want) / r[1], r[0]))
                loss = abs(best[0] - want) / best[1]
                inside = 0 <= want < length
                if inside and near <= loss < doubtful and best[3]:
                    break
                then, was = (best[0], at) if inside and loss < near else (want, at)
                step = best[2] if inside and loss < near else step
                at = then
                if not 0 <= at < length or (at - was) * way <= 0 or any(a <= at <= b for a, b in found):
                    break
                out.add(int(at))
            ends.append(at)
        found += [(place - margin, ends[0] + margin), (ends[1] - margin, place + margin)]
    return sorted(out)


def test_walks_against_asking_all_peaks(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for track in range(25):
        at, mine = rng.randrange(40), []
        while at < 1500:
            period = rng.choice([40.0, 50.0, 100.0])
            mine.append((at, rng.choice([0.3, 1.0, 2.0, rng.random() + 0.05]), period, rng.random() < 0.5, 1500.0))
            at += int(period) + rng.choice([-3, 0, 0, 2, 11])
        want[track] = plain_walk(mine, 6.0, 30.0, 20)
        rows += [(track, *r) for r in mine]
    rows.append((99, 5, 0.0, 10.0, True, 20.0))
    df = spark.createDataFrame(rows, "track long, place long, prominence double, period_ms double, sure boolean, length_ms double")
    got = {}
    for r in beats.beat_walk(df, 6.0, 30.0, 20).collect():
        got.setdefault(r.track, []).append(r.beat_ms)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_snaps_against_all_earlier_points(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ROWS", 30)
    rng = random.Random(7)
    rows = []
    for chart in range(6):
        at = 0
        for seq in range(120):
            at += rng.choice([0, 0, 30, 200, 900, 1001, 2500])
            rows.append((chart, seq, at, *((None, 1.0) if rng.random() < 0.05 else (rng.random() * 16 - 4, rng.random() * 12 - 4))))
    rows += [(0, 500, None, 1.0, 1.0), (None, 1, 0, 0.0, 0.0), (None, 2, 10, 1.0, 1.0)]
    want = []
    for chart in {r[0] for r in rows}:
        done = []
        for _, seq, t, x, y in sorted((r for r in rows if r[0] == chart and r[2] is not None), key=lambda r: (r[2], r[1])):
            for u, v, w in done:
                if None not in (x, u) and u is not None and w >= t - 1000 and math.hypot(u - x, v - y) < 3.8:
                    x, y = u, v
                    break
            done.append((x, y, t))
            want.append((-1 if chart is None else chart, seq, x, y))
    want.append((0, 500, 1.0, 1.0))
    df = spark.createDataFrame(rows, "chart long, seq long, time_ms long, x double, y double")
    none = lambda v: None if v is None or v != v else v
    got = [(-1 if r.chart is None else r.chart, r.seq, none(r.x), none(r.y)) for r in sequential.snapped_overlaps(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert clusters.clusters(df.where("chart = 1"), "chart", "time_ms", 1001).select("_cluster").distinct().count() > 2


def test_clusters_are_apart_and_of_a_size(spark):
    rng = random.Random(3)
    at, rows = 0, []
    for i in range(2000):
        at += rng.choice([0, 1, 3, 8, 30])
        rows.append((1, at, i))
    df = spark.createDataFrame(rows, "k long, t long, i long")
    cut = clusters.clusters(df, "k", "t", 10, rows=100).orderBy("t", "i").collect()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        assert a._cluster == b._cluster or b.t - a.t > 10
    assert 10 <= len({r._cluster for r in cut}) <= 20
    halves = clusters.clusters(df, "k", "t", 10, rows=100, may_start=F.max("i") > 1000).groupBy("_cluster").count().collect()
    assert max(r["count"] for r in halves) > 900


def test_progress_is_that_of_the_nearest_point_of_the_path():
    """Between flattened points too: it moves evenly along a line, and is nearest among very many points of curves."""
    from cadence.functions import curves

    line = np.array([[0.0, 0.0], [100.0, 0.0]])
    assert [curves.nearest_progress(line, np.array([t, 7.0])) for t in (-5, 0, 12.5, 99, 140)] == [0, 0, 0.125, 0.99, 1]
    there_and_back = np.array([[0.0, 0.0], [100.0, 0.0], [0.0, 0.0]])
    assert curves.nearest_progress(there_and_back, np.array([50.0, 3.0])) == 0.75  # the last of two
    assert curves.nearest_progress(line[:1], np.array([1.0, 1.0])) == 0
    rng = np.random.default_rng(3)
    for kind in "BCLP":
        for _ in range(10):
            path = curves.flatten(kind, rng.uniform(0, 400, (3 if kind == "P" else 5, 2)))
            spot, along = rng.uniform(0, 400, 2), np.concatenate([[0.0], np.hypot(*np.diff(path, axis=0).T).cumsum()])
            at = np.linspace(0, along[-1], 200_001)
            far = np.hypot(np.interp(at, along, path[:, 0]) - spot[0], np.interp(at, along, path[:, 1]) - spot[1])
            p = curves.nearest_progress(path, spot) * along[-1]
            assert abs(np.hypot(np.interp(p, along, path[:, 0]) - spot[0], np.interp(p, along, path[:, 1]) - spot[1]) - far.min()) < 1e-3


def test_steps_of_sections(spark):
    from cadence.functions import scalars

    rows = spark.createDataFrame([(s,) for s in (100, 33, 16, 27, 30, 3, 0, None)], "steps int")
    got = {r.steps: (r.a, r.b) for r in rows.select("steps", scalars.section_steps(F.col("steps"), [5, 10, 1]).alias("a"), scalars.strided_steps(F.col("steps"), 8).alias("b")).collect()}
    for steps in (100, 33, 16, 27, 30, 3):
        want, start = [], 0
        for i, n in enumerate([5, 10, 1]):
            size = steps // 3 + (i < steps % 3)
            want = None if want is None or size < n else want + [start + round(k * ((size - 1) / (n - 1) if n > 1 else 1)) for k in range(n)]
            start += size
        strides = [list(range(0, steps, i)) for i in range(1, steps) if len(range(0, steps, i)) == 8]
        assert got[steps] == (want, strides[0] if strides else None)
    assert got[0] == got[None] == (None, None)
