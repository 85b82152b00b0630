"""Small worked cases for boundaries, ties, empty groups and nulls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions import curves, scalars, tokens
from cadence.operators import aggregates, filters, joins, ranking, sequential, windows


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_band_ends_are_included(spark):
    left = spark.createDataFrame([(1, 0), (1, 10), (1, 21), (2, 0), (1, None)], "k long, t long")
    right = spark.createDataFrame([(1, 20), (1, None), (3, 0)], "k long, t long")
    found = {(r.k, r.t): r.matched for r in joins.band_matched(left, right, "k", "t", 10).collect()}
    assert found == {(1, 0): False, (1, 10): True, (1, 21): True, (2, 0): False, (1, None): False}


def test_band_against_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = ([(int(k), int(t)) for k, t in zip(rng.integers(0, 3, 200), rng.integers(-500, 500, 200), strict=True)] for _ in range(2))
    found = joins.band_matched(spark.createDataFrame(a, "k long, t long"), spark.createDataFrame(b, "k long, t long"), "k", "t", 4)
    want = sorted((k, t, any(k == m and abs(t - u) <= 4 for m, u in b)) for k, t in a)
    assert values(found, "k", "t", "matched") == want


@pytest.mark.parametrize("direction,strict,want", [("backward", False, 2), ("backward", True, 1), ("forward", False, 2), ("forward", True, 3)])
def test_asof_at_equal_times(spark, direction, strict, want):
    right = spark.createDataFrame([(1, 0, 1), (1, 5, 2), (1, 9, 3)], "k long, t long, v long")
    left = spark.createDataFrame([(1, 5)], "k long, t long")
    assert joins.asof(left, right, "k", "t", ["v"], direction, strict).first().v == want


def test_asof_falls_back_to_first(spark):
    right = spark.createDataFrame([(1, 5, 2), (1, 9, 3)], "k long, t long, v long")
    left = spark.createDataFrame([(1, 1), (2, 1)], "k long, t long")
    assert values(joins.asof(left, right, "k", "t", ["v"], or_first=True), "k", "v") == [(1, 2), (2, None)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("or_first", [False, True])
def test_asof_by_buckets_is_the_same(spark, direction, strict, or_first):
    rng = np.random.default_rng(12)
    right = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(-300, 300, 60), strict=True))] + [(5, None, 99)]
    left = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 6, 200), rng.integers(-400, 400, 200), strict=True))] + [(1, None, 999), (None, 5, 998)]
    a, b = spark.createDataFrame(left, "k long, t long, id long"), spark.createDataFrame(right, "k long, t long, v long")
    plain, spread = (values(joins.asof(a, b, "k", "t", ["v"], direction, strict, or_first=or_first, bucket=w), "id", "v") for w in (None, 50))
    assert plain == spread and len(plain) == 202
    for i, v in plain:
        k, t, _ = next(x for x in left if x[2] == i)
        own = [(u, w) for j, u, w in right if j == k and u is not None] if k is not None and t is not None else []
        fits = [(u, w) for u, w in own if (u < t if strict else u <= t)] if direction == "backward" else [(u, w) for u, w in own if (u > t if strict else u >= t)]
        best = (max if direction == "backward" else min)(fits, default=min(own, default=(0, None)) if or_first else (0, None))
        assert v == best[1]


def test_positions_and_order_statistics(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    assert all(r.x == r.position for r in ranking.with_position(df, ["x"]).collect())
    got = dict(values(ranking.order_statistics(df, "x", [0.0, 0.5, 1.0]), "q", "x"))
    assert got == {0.0: 0, 0.5: 50, 1.0: 99}
    assert ranking.with_position(df.limit(0), ["x"]).count() == 0


def test_dictionary_by_first_appearance(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), (None, 3)], "s string, n int")
    assert values(ranking.dictionary(df, "s", "n"), "s", "code") == [("a", 1), ("b", 0)]


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 9.99, 10.0, 10.1)], "x double")
    assert [r[0] for r in df.select(aggregates.closed_bin(F.col("x"), 0, 10, 5)).collect()] == [None, 0, 4, 4, None]


def test_dominant_period_prefers_latest_of_ties(spark):
    df = spark.createDataFrame([(1, 0, 300.0, 200), (1, 100, 400.0, 200)], "k long, t long, p double, stop long")
    assert aggregates.dominant_period(df, "k", "t", "p", "stop").first().p == 400.0


def test_moments_and_frechet(spark):
    x = np.random.default_rng(1).normal(size=(200, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>")
    n, mean, cov = aggregates.moments(df, "v", 4)
    assert n == 200 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x, rowvar=False))
    assert abs(aggregates.frechet((mean, cov), (mean, cov))) < 1e-9
    assert aggregates.frechet((mean, cov), (mean + 1, cov)) == pytest.approx(4)
    assert aggregates.frechet((np.zeros(2), np.diag([1.0, 4.0])), (np.zeros(2), np.diag([4.0, 1.0]))) == pytest.approx(2)


def test_filters(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (5, 4)], "s long, i long")
    assert values(filters.by_set_rank(df, "s", 1, 3), "i") == [(3,), (4,)]
    assert values(filters.sets_with(df, "s", F.count("*") > 1), "i") == [(1,), (2,)]
    assert values(filters.last_of_set(df, "s", [F.desc("i")]), "i") == [(2,), (3,), (4,)]


def test_resnap_and_divisors(spark):
    assert [scalars.coarser_divisors(d) for d in (1, 4, 6, 12, 16, 7)] == [[], [2], [2, 3], [4, 6], [8], [1]]
    df = spark.createDataFrame([(130.0, None, 4), (130.0, None, 1), (495.0, 500.0, 4), (130.0, None, 0)], "t double, nxt double, d int")
    got = [r[0] for r in df.select(scalars.resnapped(F.col("t"), F.lit(0.0), F.lit(500.0), F.col("nxt"), F.col("d"))).collect()]
    assert got == [125, 0, 500, 130]


def test_pack_and_unpack_are_inverse(spark):
    df = spark.range(72).select(F.col("id").cast("int").alias("c")).select("c", scalars.unpack_hitsound(F.col("c")).alias("u"))
    assert df.where(scalars.pack_hitsound(F.col("u.sound"), F.col("u.sample_set"), F.col("u.addition_set")) != F.col("c")).count() == 0


def test_tokens_round_trip(spark):
    v = tokens.layout(spark.createDataFrame([(0, "a", -2, 3), (1, "b", 5, 5)], "seq int, type string, lo int, hi int"), 3)
    events = spark.createDataFrame([("a", -2), ("a", 3), ("b", 5), ("b", 6), ("c", 0)], "t string, x int")
    coded = tokens.encode(events, v, "t", "x")
    assert [r.token for r in coded.collect()] == [3, 8, 9, None, None]
    back = tokens.decode(coded.where("token IS NOT NULL"), v, "token")
    assert back.where("t <> type OR x <> value").count() == 0
    with pytest.raises(Exception, match="out of range"):
        tokens.strict(coded).collect()


def test_windows_small(spark):
    df = spark.createDataFrame([(1, i, None if i in (1, 2) else i * 30) for i in range(5)], "k long, seq long, t long")
    assert values(windows.gap_filled(df, "k", "t", "seq"), "t") == [(0,), (30,), (60,), (90,), (120,)]
    rows = spark.createDataFrame([(1, i) for i in range(5)], "k long, p long")
    assert values(windows.sliding(rows, "k", "p", 4, 2).groupBy("window").count(), "window", "count") == [(0, 4)]
    packed = windows.packed_batches(spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "g long, s long, w long"), "g", "s", "w", 5)
    assert values(packed, "batch", "s", "units") == [(0, 1, 3), (0, 2, 2), (1, 2, 2)]
    w = Window.partitionBy("k").orderBy("p")
    assert [r[0] for r in rows.select(windows.carried(F.when(F.col("p") == 1, F.col("p")), w, 9)).collect()] == [9, 9, 1, 1, 1]


def test_timing_edits(spark):
    point = {"track": 1, "value": 300.0, "meter": 4, "sample_type": 2, "sample_set": 0, "volume": 100, "kiai": False, "is_red": True}
    points = spark.createDataFrame([point | {"offset_ms": 0}], sequential.POINTS)
    base = {f"set_{f}": False for f in ("value", "meter", "sample_type", "sample_set", "volume", "kiai")}
    schema = sequential.POINTS + ", seq long, " + ", ".join(f"{k} boolean" for k in base)
    change = point | base | {"seq": 1, "offset_ms": 500, "is_red": False}
    quiet = spark.createDataFrame([change | {"volume": 40, "set_volume": True}], schema)
    got = values(sequential.timing_edits(points, quiet), "offset_ms", "value", "volume", "is_red")
    assert got == [(0, 300.0, 100, True), (500, -100.0, 40, False)]
    same = spark.createDataFrame([change | {"set_volume": True}], schema)
    assert sequential.timing_edits(points, same).count() == 2  # a green point differs from the red one before it
    red = spark.createDataFrame([change | {"is_red": True, "value": 400.0, "set_value": True, "offset_ms": 1}], schema)
    assert values(sequential.timing_edits(points, red), "offset_ms", "value") == [(0, 400.0)]


def edited(points, changes, all_after, fuzz=2):
    """timing_edits by plain rules: one dict per point, every point looked at for every change."""
    fields = ["sample_type", "sample_set", "volume", "kiai"]
    own = sorted(({k: p[k] for k in ("offset_ms", "value", "meter", *fields, "is_red")} for p in points), key=lambda p: (p["offset_ms"], not p["is_red"]))
    for c in sorted(changes, key=lambda c: (c["offset_ms"], c["seq"])):
        here = [p for p in own if abs(p["offset_ms"] - c["offset_ms"]) <= fuzz]
        last = None
        for p in own:
            if p["offset_ms"] < c["offset_ms"] and (last is None or p["offset_ms"] >= last["offset_ms"]):
                last = p
        last = here[-1] if here else last
        new = None
        if (c["is_red"] and not any(p["is_red"] for p in here)) or (not c["is_red"] and (not here or (c["set_value"] and all(p["is_red"] for p in here)))):
            new = {k: (last or c)[k] for k in ("value", "meter", *fields)} | {"offset_ms": c["offset_ms"], "is_red": c["is_red"]}
            if last and last["is_red"] and not c["is_red"]:
                new["value"] = -100.0
        for p in [*here, *([new] if new else [])]:
            if c["set_value"] and p["is_red"] == c["is_red"]:
                p["value"] = c["value"]
            if c["set_meter"] and p["is_red"] and c["is_red"]:
                p["meter"] = c["meter"]
            p |= {f: c[f] for f in fields if c[f"set_{f}"]}
        if new and (c["is_red"] or last is None or {**new, "offset_ms": 0} != {**last, "offset_ms": 0}):
            own.append(new)
        if all_after:
            for p in own:
                if p["offset_ms"] > c["offset_ms"]:
                    p |= {f: c[f] for f in fields if c[f"set_{f}"]}
        own.sort(key=lambda p: (p["offset_ms"], not p["is_red"]))
    return own


@pytest.mark.parametrize("all_after", [False, True])
def test_timing_edits_against_plain_rules(spark, all_after):
    rng = np.random.default_rng(9)
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def point(track, red):
        return {"track": track, "offset_ms": int(rng.integers(0, 40)), "value": float(pick(300, 400) if red else pick(-50, -100)), "meter": int(pick(3, 4)), "sample_type": 1,
                "sample_set": int(pick(0, 1)), "volume": int(pick(40, 60)), "kiai": bool(pick(True, False)), "is_red": red}

    flags = [f"set_{f}" for f in ("value", "meter", "sample_type", "sample_set", "volume", "kiai")]
    points = [point(t, bool(rng.random() < 0.4)) for t in range(8) for _ in range(t)]
    changes = [point(t, bool(rng.random() < 0.4)) | {"seq": k} | {f: bool(rng.random() < 0.4) for f in flags} for t in range(8) for k in range(12)]
    schema = sequential.POINTS + ", seq long, " + ", ".join(f"{k} boolean" for k in flags)
    got = sequential.timing_edits(spark.createDataFrame(points, sequential.POINTS), spark.createDataFrame(changes, schema), all_after=all_after).collect()
    key = ("offset_ms", "value", "meter", "sample_type", "sample_set", "volume", "kiai", "is_red")
    for t in range(8):
        want = edited([p for p in points if p["track"] == t], [c for c in changes if c["track"] == t], all_after)
        assert [tuple(r[k] for k in key) for r in got if r.track == t] == [tuple(p[k] for k in key) for p in want]


@pytest.mark.parametrize("all_after", [False, True])
def test_timing_edits_of_a_long_track_in_parts(spark, all_after, monkeypatch):
    """A track of some hundred points and changes, cut into parts, is as by plain rules over all of it."""
    from cadence.operators import clusters

    monkeypatch.setattr(clusters, "ROWS", 40)
    rng = np.random.default_rng(5)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    flags = [f"set_{f}" for f in ("value", "meter", "sample_type", "sample_set", "volume", "kiai")]

    def row(red):
        return {"track": 7, "offset_ms": int(rng.integers(0, 4000)), "value": float(pick(300, 400) if red else pick(-50, -100)), "meter": int(pick(3, 4)), "sample_type": 1, "sample_set": int(pick(0, 1)),
                "volume": int(pick(40, 60, 80)), "kiai": bool(pick(True, False)), "is_red": red}

    points = list({(p["offset_ms"], p["is_red"]): p for p in (row(bool(rng.random() < 0.3)) for _ in range(260))}.values())
    changes = [row(bool(rng.random() < 0.3)) | {"seq": k} | {f: bool(rng.random() < 0.4) for f in flags} for k in range(180)]
    schema = sequential.POINTS + ", seq long, " + ", ".join(f"{k} boolean" for k in flags)
    found = sequential.timing_edits(spark.createDataFrame(points, sequential.POINTS), spark.createDataFrame(changes, schema), all_after=all_after)
    key = ("offset_ms", "is_red", "value", "meter", "sample_type", "sample_set", "volume", "kiai")
    assert sorted(tuple(r[k] for k in key) for r in found.collect()) == sorted(tuple(p[k] for k in key) for p in edited(points, changes, all_after))
    parts = clusters.clusters(spark.createDataFrame(points, sequential.POINTS), "track", "offset_ms", 5)
    assert parts.select("_cluster").distinct().count() >= 5


def test_green_change_after_red_and_green_at_one_time(spark):
    red = {"track": 1, "offset_ms": 0, "value": 300.0, "meter": 4, "sample_type": 2, "sample_set": 0, "volume": 100, "kiai": False, "is_red": True}
    points = spark.createDataFrame([red, red | {"value": -50.0, "is_red": False}], sequential.POINTS)
    flags = {f"set_{f}": f == "volume" for f in ("value", "meter", "sample_type", "sample_set", "volume", "kiai")}
    change = red | flags | {"offset_ms": 1000, "volume": 40, "is_red": False, "seq": 0}
    changes = spark.createDataFrame([change], sequential.POINTS + ", seq long, " + ", ".join(f"{k} boolean" for k in flags))
    assert values(sequential.timing_edits(points, changes), "offset_ms", "value", "volume")[-1] == (1000, -50.0, 40)


def walked_times(events, end, types_first):
    """Times of (kind, value) events by walking back (or on) and looking ahead for the next time shift each time."""
    times, now = [], 0
    for i, (kind, value) in enumerate(events):
        if types_first:
            now = events[i + 1][1] if i + 1 < len(events) and events[i + 1][0] == "time_shift" else now
        elif kind == "time_shift":
            now = value
        times.append(now)
    if not events:
        return times
    own, step, now, inside = list(times), 1 if types_first else -1, times[0] if types_first else end, False
    for i in range(len(events))[::step]:
        kind = events[i][0]
        inside = kind == "point" or (inside and kind not in ("timed", "time_shift"))
        if not inside:
            now = own[i]
        elif kind == "point":
            j, count = i, 0
            while 0 <= j < len(events) and events[j][0] != "time_shift":
                count += events[j][0] == "point"
                j += step
            goal = own[j] if 0 <= j < len(events) else end if j >= 0 else 0
            now = int((now - goal) / (count + 1) * count + goal)
        times[i] = now
    return times


@pytest.mark.parametrize("types_first", [False, True])
def test_timed_events_against_a_walk(spark, types_first):
    rng = np.random.default_rng(4)
    streams = [[(str(rng.choice(["point", "point", "other", "timed", "time_shift"])), int(rng.integers(0, 5000))) for _ in range(rng.integers(0, 40))] for _ in range(20)]
    rows = [(k, i, kind, value) for k, s in enumerate(streams) for i, (kind, value) in enumerate(s)]
    df = spark.createDataFrame(rows, "k long, seq long, kind string, value long")
    got = windows.timed_events(df, "k", "seq", "kind", "value", ["point"], ["timed"], F.lit(7000), types_first).orderBy("k", "seq").collect()
    want = [t for s in streams for t in walked_times(s, 7000, types_first)]
    assert [r.time_ms for r in got] == want


def test_slider_anchor_times(spark):
    """T-D-Start-D-CP-D-CP-T-D-LCP-T-D-End at 1, 7 and 9: control points at 3 and 5."""
    kinds = "T D Start D CP D CP T D LCP T D End".split()
    at = iter([1, 7, 9])
    rows = [(1, i, "time_shift" if k == "T" else k, next(at) if k == "T" else None) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "k long, seq long, kind string, value long")
    got = windows.timed_events(df, "k", "seq", "kind", "value", ["CP"], ["Start", "LCP", "End"], F.lit(10)).orderBy("seq").collect()
    assert [r.time_ms for r in got] == [1, 1, 1, 3, 3, 5, 5, 7, 7, 7, 9, 9, 9]


def test_smoothing_reflects_at_ends(spark):
    """As convolving the signal with its mirror images at both ends."""
    rng = np.random.default_rng(2)
    signal = rng.integers(0, 5, 30).astype(float)
    kernel = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
    want = np.convolve(np.concatenate([signal[::-1], signal, signal[::-1]]), kernel / kernel.sum(), "same")[30:60]
    df = spark.createDataFrame([(1, i, float(x), 30) for i, x in enumerate(signal)], "k long, at long, v double, size long")
    got = [r.v for r in windows.smoothed(df, "k", "at", "v", 3.0, "size").orderBy("at").collect()]
    assert np.allclose(got, want)


def test_counts_between_and_beats_between(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 5, 1), (1, 5, 0), (1, 9, 5), (2, 5, 0)], "k long, t long, b int")
    spans = spark.createDataFrame([(1, 1, 0, 5), (2, 1, 6, 9), (3, 3, 0, 9)], "id long, k long, lo long, hi long")
    assert values(windows.counts_between(spans, rows, "k", "t", "lo", "hi", "b", 2), "id", "counts") == [(1, [2, 1]), (2, [0, 0]), (3, [0, 0])]
    points = spark.createDataFrame([(1, 100, 10.0), (1, 200, 20.0)], "k long, t long, p double")
    spans = spark.createDataFrame([(1, 1, 0, 150), (2, 1, 150, 260), (3, 1, 50, 40), (4, 9, 0, 10)], "id long, k long, x long, y long")
    assert values(windows.beats_between(points, "k", "t", "p", spans, "x", "y"), "id", "beats") == [(1, 5.0), (2, 8.0), (3, 0.0), (4, 0.0)]


def test_upper_median_of_a_frequent_key(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), float(v)) for k, v in zip(np.where(rng.random(500) < 0.7, 0, rng.integers(1, 9, 500)), rng.integers(0, 50, 500), strict=True)] + [(99, None)]
    want = sorted((k, sorted(v for j, v in rows if j == k)[sum(j == k for j, _ in rows) // 2]) for k in {k for k, v in rows if v is not None})
    assert values(aggregates.upper_median(spark.createDataFrame(rows, "k long, v double"), "k", "v"), "k", "upper_median") == want


def test_file_names_are_composed(spark):
    df = spark.createDataFrame([("  \uff21\ufb01 e\u0301: a\u3000\u3000b ",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.slug(F.col("t"))).collect()] == ["Afi \xe9 a b", None]


def test_snapped_overlaps(spark):
    rows = [(1, 1, 0, 100.0, 100.0), (1, 2, 500, 102.0, 100.0), (1, 3, 1200, 105.0, 100.0), (1, 4, 1300, None, None)]
    got = values(sequential.snapped_overlaps(spark.createDataFrame(rows, "chart long, seq long, time_ms long, x double, y double")), "seq", "x")
    assert got[:3] == [(1, 100.0), (2, 100.0), (3, 105.0)] and (got[3][1] is None or math.isnan(got[3][1]))


def test_tempo_sections(spark):
    times = [0, 500, 1000, 1500, 1900, 2300, 2700]
    rows = spark.createDataFrame([(1, t, t == 0) for t in times], "track long, time_ms long, is_red boolean")
    got = values(sequential.tempo_sections(rows), "offset_ms", "ms_per_beat", "beats")
    assert got == [(0, 500.0, 3), (1500, 400.0, 3)]


def reds(spark, markers):
    found = sequential.red_points(spark.createDataFrame([(1, t, k) for t, k in markers], "track long, time_ms long, kind string"))
    return [(r.offset_ms, round(r.ms_per_beat, 6), r.meter) for r in found.orderBy("offset_ms").collect()]


def bars(start, period, n, meter=4, first="measure"):
    """n beats from `start`, measures every `meter`."""
    return [(round(start + k * period), first if k == 0 else "measure" if k % meter == 0 else "beat") for k in range(n)]


def test_red_points(spark):
    """Steady beats; uneven ones within the leniency; three to a measure; another tempo, marked and unmarked; a cut measure."""
    assert reds(spark, bars(100, 500, 17, first="timing_point")) == [(100, 500.0, 4)]
    assert reds(spark, [(t + 7 * (i % 2), k) for i, (t, k) in enumerate(bars(0, 400, 30))]) == [(0, 400.0, 4)]
    assert reds(spark, bars(0, 500, 13, meter=3)) == [(0, 500.0, 3)]
    assert reds(spark, bars(0, 500, 9, first="timing_point") + bars(4500, 400, 9, first="timing_point")) == [(0, 500.0, 4), (4500, 400.0, 4)]
    assert reds(spark, bars(0, 500, 9) + bars(4000, 300, 17)[1:]) == [(0, 500.0, 4), (4000, 300.0, 4)]
    # two beats after the second measure another one comes: a point with meter 2 there, then 4 again
    cut = bars(0, 500, 5) + [(2500, "beat")] + bars(3000, 500, 9)
    assert reds(spark, cut) == [(0, 500.0, 4), (2000, 500.0, 2), (3000, 500.0, 4)]
    # red points alone, an eighth apart at the tempo before
    close = bars(0, 500, 5, first="timing_point") + [(2062, "timing_point")] + bars(2500, 500, 4)
    assert reds(spark, [(0, "timing_point")]) == [(0, 1000.0, 4)] and len(reds(spark, close)) >= 2


def test_best_cut_against_trying_all():
    rng = np.random.default_rng(7)
    for _ in range(20):
        n = int(rng.integers(3, 30))
        times, beats = np.sort(rng.integers(100, 9000, n)).astype(float), rng.choice([1.0, 1.0, 0.5], n)
        allowed = np.concatenate([[False], rng.random(n - 1) < 0.7])
        allowed[-1] = True

        def loss(t, b, start):
            total = np.cumsum(b)
            p = sequential._exact_period(t[-1] - start, total[-1], 0)
            return ((t - start - p * total) ** 2).mean()

        losses = {i: loss(times[:i], beats[:i], 50.0) + loss(times[i:], beats[i:], times[i - 1]) for i in range(1, n) if allowed[i]}
        got = sequential._best_cut(times, beats, allowed, 50.0)
        assert losses[got] <= min(losses.values()) * (1 + 1e-6) + 1e-3


def test_measure_votes_against_voting_one_by_one(spark):
    """The same votes as a countdown over single beats."""
    rng = np.random.default_rng(8)
    rows, want = [], []
    for track in range(12):
        n, meter = int(rng.integers(1, 60)), 4
        score, red = rng.integers(0, 9, n) + 5 * (np.arange(n) % meter == 1), rng.random(n) < 0.05
        rows += [(track, i, float(score[i]), bool(red[i])) for i in range(n)]
        wait, out = 0, [False] * n
        for i in range(n):
            if wait > 0:
                wait -= 1
            elif wait < 0:
                wait += 1
                if wait == 0 and not red[i]:
                    out[i], wait = True, meter - 1
            elif not red[i]:
                means = []
                for k in range(meter):
                    seen = [j for j in range(-3, 4) if 0 <= i + j * meter + k < n and not any(red[m if j > 0 else -m] for m in range(1, abs(j)))]
                    means.append(sum(score[i + j * meter + k] for j in seen) / len(seen) if seen else 0)
                k = int(np.argmax(means))
                out[i], wait = k == 0, meter - 1 if k == 0 else -k
        want += [(track, i, out[i]) for i in range(n)]
    got = sequential.measure_votes(spark.createDataFrame(rows, "track long, seq long, score double, is_red boolean"), 4)
    assert values(got, "track", "seq", "measure") == want


@pytest.mark.parametrize("types_first", [False, True])
def test_trimmed_windows_against_a_loop(spark, types_first):
    rng = np.random.default_rng(3)
    kinds = ["time_shift", "time_shift", "circle", "end", "eos"]
    rows = [(1, w, i, str(rng.choice(kinds, p=[0.3, 0.2, 0.25, 0.2, 0.05])), int(rng.integers(0, 100))) for w in range(12) for i in range(int(rng.integers(0, 9)))]
    step, stride, size, back, ahead = 10, 400, 1000, 0.3, 0.4
    want, now, last = [], 0, max(w for _, w, *_ in rows)
    for w in range(last + 1):
        own = [r for r in rows if r[1] == w]
        while own and own[-1][3] == "eos":
            own.pop()
        if own and own[-1][3] == "time_shift" and ((w < last and own[-1][4] >= 60) or (types_first and w > 0 and own[-1][4] < 30)):
            own = own[: -2 if types_first else -1]
        own = own[: next((i for i, r in enumerate(own) if r[3] == "eos"), len(own))]
        timed, here = [], now
        for i, (_, _, seq, kind, value) in enumerate(own):
            value = w * stride + value * step if kind == "time_shift" else value
            if kind == "time_shift" and not types_first:
                here = value
            elif types_first and i + 1 < len(own) and own[i + 1][3] == "time_shift":
                here = w * stride + own[i + 1][4] * step
            timed.append((w, seq, kind, value, here))
        while w < last and timed and timed[-1][4] > w * stride + (1 - ahead) * size:
            timed.pop()
        now = timed[-1][4] if timed else now
        want += timed
    df = spark.createDataFrame(rows, "k long, window long, seq long, kind string, value long")
    got = windows.trimmed_windows(df, "k", step, stride, size, back, ahead, types_first)
    assert values(got, "window", "seq", "kind", "value", "time_ms") == want


def test_curves():
    line = np.array([[0.0, 0.0], [10.0, 0.0]])
    assert np.allclose(curves.flatten("B", line, 4)[:, 0], [0, 2.5, 5, 7.5, 10])
    circle = curves.flatten("P", np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), 20)
    assert np.allclose(np.hypot(*circle.T), 1) and circle[10] == pytest.approx([0, 1])
    corner = curves.flatten("B", np.array([[0.0, 0], [5, 0], [5, 0], [5, 5]]), 2)
    assert [5.0, 0.0] in corner.tolist()
    assert curves.catmull(line, 5)[-1].tolist() == [10, 0]


def test_neighbours_of_more_queries_than_a_block(spark):
    queries = spark.range(10_001).select("id", F.array(F.col("id").cast("double")).alias("v"))
    rows = spark.createDataFrame([(20_000, [-1.0]), (20_001, [20_000.0])], "id long, v array<double>")
    for nearest in (True, False):
        got = joins.neighbours(queries, rows, "id", "v", 1, nearest).collect()
        far = {q: abs(q + 1) > abs(20_000 - q) for q in range(10_001)}
        assert sorted((r.query, r.id) for r in got) == [(q, 20_000 + int(far[q] == nearest)) for q in far]
