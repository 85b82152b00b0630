"""Operators that walk an ordered group: grouped pandas functions over one track or chart at a time.

Groups are tracks, whose size has a natural bound (a song); partition by track, not by set. Each function is a small
fold; selection, joining and ordering stay in Spark.
"""

from __future__ import annotations

from collections import deque
from math import hypot

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators.clusters import clusters

POINT_FIELDS = ["sample_type", "sample_set", "volume", "kiai"]
POINT_SCHEMA = pa.schema([
    ("track", pa.int64()), ("offset_ms", pa.int64()), ("value", pa.float64()), ("meter", pa.int32()), ("sample_type", pa.int32()), ("sample_set", pa.int32()),
    ("volume", pa.int32()), ("kiai", pa.bool_()), ("is_red", pa.bool_()),
])
POINTS = "track long, offset_ms long, value double, meter int, sample_type int, sample_set int, volume int, kiai boolean, is_red boolean"


def timing_edits(points: DataFrame, changes: DataFrame, all_after: bool = False, fuzz_ms: int = 2) -> DataFrame:
    """Timing points (see POINTS) after a track's changes, applied in order of (offset_ms, seq).

    A change has the fields of a point, seq, and booleans set_value, set_meter, set_sample_type, set_sample_set,
    set_volume, set_kiai. It edits the points within `fuzz_ms` of its offset. A red change without a red point there
    makes one; a green change makes one if nothing is there, or if it sets the value and no green point is there. A new
    point copies the last one at or before it; it is kept if it is red or differs from that one. With `all_after`,
    samples, volume and kiai spread to all later points. A track's result is sorted, red before green, in each part;
    points alike in both are in order of their values.

    Tracks are cut before points that no earlier change reaches, so that neither edits nor the copied point of a new
    one come from another part; what spreads to all later points is found by windows over parts and set first. Points
    of parts without changes never leave the JVM.
    """

    names = ["value", "meter", *POINT_FIELDS]
    fields = [f.name for f in POINT_SCHEMA]
    both = points.select(*fields, F.lit(True).alias("_point")).unionByName(changes.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    firsts = [F.min(F.when(F.col("_point") == k, F.col("offset_ms"))) for k in (True, False)]
    may_start = firsts[0].isNotNull() & (firsts[1].isNull() | (firsts[0] <= firsts[1] + fuzz_ms))
    both = clusters(both, "track", "offset_ms", 2 * fuzz_ms + 1, may_start=may_start)
    order = F.struct("offset_ms", "seq")
    last = [F.max_by(f, F.when(F.col(f"set_{f}") & ~F.col("_point"), order)).alias(f"_{f}") for f in POINT_FIELDS]
    parts = both.groupBy(F.col("track").alias("_of"), F.col("_cluster").alias("_part")).agg(F.bool_or(~F.col("_point")).alias("_edited"), *last)
    before = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    from_before = [(F.last(f"_{f}", ignorenulls=True).over(before) if all_after else F.lit(None)).alias(f"_{f}") for f in POINT_FIELDS]
    parts = parts.select("_of", "_part", "_edited", *from_before)
    both = both.join(parts, F.col("track").eqNullSafe(F.col("_of")) & F.col("_cluster").eqNullSafe(F.col("_part"))).drop("_of", "_part")
    for f in POINT_FIELDS:
        both = both.withColumn(f, F.when(F.col("_point"), F.coalesce(f"_{f}", f)).otherwise(F.col(f)))
    both = both.drop(*(f"_{f}" for f in POINT_FIELDS))

    def fold(rows: pa.Table) -> pa.Table:
        left, right = rows.filter(pc.field("_point")), rows.filter(~pc.field("_point"))
        left = left.sort_by([(f, "ascending") for f in names if f != "kiai"])
        at = np.array(left["offset_ms"].to_pylist(), "i8")
        red = np.array(left["is_red"].to_pylist(), bool)
        order = np.lexsort((~red, at))
        at, red = at[order], red[order]
        own = {f: np.array(left[f].to_pylist(), object)[order] for f in names}
        track = (left["track"] if len(left) else right["track"])[0].as_py()
        for c in sorted(right.to_pylist(), key=lambda c: (c["offset_ms"], c["seq"])):
            t = c["offset_ms"]
            lo, hi = np.searchsorted(at, t - fuzz_ms, "left"), np.searchsorted(at, t + fuzz_ms, "right")
            # the last point here, else the last one before: of points at one time a green one, as they are sorted
            last = hi - 1 if hi > lo else np.searchsorted(at, t, "left") - 1
            here = slice(lo, hi)
            wanted = not red[here].any() if c["is_red"] else hi == lo or (c["set_value"] and red[here].all())
            new = {f: own[f][last] if last >= 0 else c[f] for f in names}
            if last >= 0 and red[last] and not c["is_red"]:
                new["value"] = -100.0  # a green point's neutral speed
            alike = red[here] == c["is_red"]
            sets = {f: c[f] for f in POINT_FIELDS if c[f"set_{f}"]}
            if c["set_value"]:
                own["value"][here][alike] = c["value"]
                new["value"] = c["value"]
            if c["set_meter"] and c["is_red"]:
                own["meter"][here][alike] = c["meter"]
                new["meter"] = c["meter"]
            for f, v in sets.items():
                own[f][here] = v
            new |= sets
            if all_after:
                for f, v in sets.items():
                    own[f][np.searchsorted(at, t, "right") :] = v
            if wanted and (c["is_red"] or last < 0 or red[last] or any(new[f] != own[f][last] for f in names)):
                k = np.searchsorted(at, t, "left" if c["is_red"] else "right")
                k += int(red[k : np.searchsorted(at, t, "right")].sum()) if c["is_red"] else 0
                at, red = np.insert(at, k, t), np.insert(red, k, c["is_red"])
                own = {f: np.insert(x, k, new[f]) for f, x in own.items()}
        columns = {"track": [track] * len(at), "offset_ms": at, **{f: x.tolist() for f, x in own.items()}, "is_red": red}
        return pa.table({f.name: pa.array(columns[f.name], f.type) for f in POINT_SCHEMA}, POINT_SCHEMA)

    # as many tasks as the session says: small tables would be put together into one
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edited = both.where("_edited").drop("_edited").repartition(tasks, "track", "_cluster").groupBy("track", "_cluster").applyInArrow(fold, POINTS)
    return both.where("NOT _edited").select(*fields).unionByName(edited)


def snapped_overlaps(objects: DataFrame, within_px: float = 3.8, within_ms: int = 1000) -> DataFrame:
    """(chart, seq, time_ms, x, y): each point moved onto the first earlier one nearer than `within_px` and not over
    `within_ms` before it, in order of (time_ms, seq); later points see moved positions. Null positions stay; rows without
    a time come as they are.

    Charts are cut where nothing happens for longer than that. Points wait in the cells of a grid, as wide as the
    distance, so a point looks at nine cells, each in order of time.
    """
    rows = clusters(objects.select("chart", "seq", "time_ms", "x", "y"), "chart", "time_ms", within_ms + 1)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["time_ms", "seq"])
        times, x, y = (rows[c].tolist() for c in ("time_ms", "x", "y"))
        cells: dict[tuple[int, int], deque[int]] = {}
        for i, (t, u, v) in enumerate(zip(times, x, y, strict=True)):
            if u is None or v is None or u != u or v != v or t is None or t != t:
                continue
            at, first = (int(u // within_px), int(v // within_px)), None
            for cell in ((at[0] + dx, at[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                waiting = cells.get(cell)
                while waiting and times[waiting[0]] < t - within_ms:
                    waiting.popleft()
                for j in waiting or ():
                    if first is not None and j > first:
                        break
                    if hypot(x[j] - u, y[j] - v) < within_px:
                        first = j
                        break
            if first is not None:
                x[i], y[i] = x[first], y[first]
                at = int(x[i] // within_px), int(y[i] // within_px)
            cells.setdefault(at, deque()).append(i)
        return rows[["chart", "seq", "time_ms"]].assign(x=x, y=y)

    return rows.groupBy("chart", "_cluster").applyInPandas(fold, "chart long, seq long, time_ms long, x double, y double")


def measure_votes(beats: DataFrame, meter: int) -> DataFrame:
    """(track, seq, measure): which beats start a measure. Rows are (track, seq, score, is_red), seq from 0.

    A vote gives each of the next `meter` phases the mean score of up to seven beats, the phase's own and those one to
    three measures around it, as far as there are such beats. Beats j measures on, j > 1, don't count if one of the
    track's beats 1 to j - 1 is red, nor those j measures back if one of its last j - 1 is. The winner, which may be the
    beat at hand, starts a measure, and the next `meter` - 1 beats are passed over; if it is red, the beat after it
    votes. Red beats are no measures and don't vote.
    """

    def vote(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        score, red = rows["score"].to_numpy(float), rows["is_red"].to_numpy(bool)
        n = len(rows)
        hidden = {j: red[1:j].any() if j > 0 else red[max(0, n + j + 1) :].any() for j in range(-3, 4) if abs(j) > 1}
        total, count = np.zeros((n, meter)), np.zeros((n, meter))
        # summed from the last beat to the first, as DuckDB does in one thread: equal means may differ by their last bit
        for j in range(3, -4, -1):
            for k in range(meter):
                at = np.arange(n) + j * meter + k
                inside = (at >= 0) & (at < n) & (not hidden.get(j, False))
                total[inside, k] += score[at[inside]]
                count[inside, k] += 1
        best = np.divide(total, count, out=np.zeros_like(total), where=count > 0).argmax(axis=1)
        out, i = np.zeros(n, bool), 0
        while i < n:
            if red[i]:
                i += 1
                continue
            i += int(best[i])
            if i < n and not red[i]:
                out[i] = True
                i += meter
            else:
                i += 1
        return pd.DataFrame({"track": rows["track"], "seq": rows["seq"], "measure": out})

    return beats.groupBy("track").applyInPandas(vote, "track long, seq long, measure boolean")


def round_period(elapsed: float, beats: float, fits) -> float:
    """The period elapsed / beats at the roundest tempo (1, 1/2, .1, .01, .001 beats a minute) for which fits(period)."""
    if elapsed <= 0 or beats <= 0 or 60_000 * beats / elapsed < 1:
        return 1000.0
    tempo = 60_000 * beats / elapsed
    for k in (1, 2, 10, 100, 1000):
        rounded = round(tempo * k) / k
        if rounded > 0 and fits(60_000 / rounded):
            return 60_000 / rounded
    return elapsed / beats


def tempo_sections(markers: DataFrame, leniency_ms: float = 20.0) -> DataFrame:
    """(track, offset_ms, ms_per_beat, beats): red points for beat markers (track, time_ms, is_red).

    A section starts at the first marker, at red markers, and at the last marker that fits when the next one doesn't: a
    period fits if every marker of the section lies within `leniency_ms` of its beat. The periods that fit are an
    interval, so a marker costs one step.
    """

    def infer(rows: pa.Table) -> pa.Table:
        seen: dict[int, bool] = {}
        for t, red in zip(rows["time_ms"].to_pylist(), rows["is_red"].to_pylist(), strict=True):
            seen[t] = seen.get(t, False) or red
        times = sorted(seen)
        red, t = [seen[x] for x in times], np.array(times, float)
        out, start = [], 0
        while start < len(t):
            end, period, fits = start + 1, 1000.0, _Fits(t[start], leniency_ms)
            while end < len(t):
                fits.add(t[end], 1.0)
                candidate = round_period(t[end] - t[start], end - start, fits)
                if end > start + 1 and not fits(candidate):
                    break
                period = candidate
                end += 1
                if red[end - 1]:
                    break
            out.append({"track": rows["track"][0].as_py(), "offset_ms": times[start], "ms_per_beat": period, "beats": end - 1 - start})
            start = max(end - 1, start + 1)
            if start == len(t) - 1 and not red[start]:
                break
        return pa.Table.from_pylist(out, pa.schema([("track", pa.int64()), ("offset_ms", pa.int64()), ("ms_per_beat", pa.float64()), ("beats", pa.int64())]))

    return markers.select("track", "time_ms", "is_red").groupBy("track").applyInArrow(infer, "track long, offset_ms long, ms_per_beat double, beats long")


class _Fits:
    """The periods for which all beats so far, counted from a red point, lie within the leniency of their times."""

    def __init__(self, offset: float, leniency: float):
        self.offset, self.leniency, self.low, self.high, self.beats = offset, leniency, 0.0, np.inf, 0.0

    def add(self, time: float, beats: float) -> None:
        self.beats += beats
        gap = time - self.offset
        if self.beats:
            self.low, self.high = max(self.low, (gap - self.leniency) / self.beats), min(self.high, (gap + self.leniency) / self.beats)
        elif abs(gap) > self.leniency:
            self.high = -np.inf

    def __call__(self, period: float) -> bool:
        return self.low - 1e-9 <= period <= self.high + 1e-9


def _exact_period(elapsed: float, beats: float, leniency: float) -> float:
    return round_period(elapsed, beats, lambda p: abs(elapsed - p * beats) <= leniency)


def _best_cut(times: np.ndarray, beats: np.ndarray, allowed: np.ndarray, offset: float) -> int | None:
    """Where to cut markers in two so that the mean squared distances from even beats, from `offset` in the first part
    and from its last marker in the second, add up to least: the size of the first part, the smallest of equal ones.

    Running sums of times, beats and their products give every cut's loss at once.
    """
    t, b = times - offset, np.cumsum(beats)
    tt, tb, bb, st, sb = (np.concatenate([[0.0], np.cumsum(x)]) for x in (t * t, t * b, b * b, t, b))
    n, best, least = len(t), None, np.inf
    for i in np.flatnonzero(allowed).tolist():
        p = _exact_period(t[i - 1], b[i - 1], 0)
        first = (tt[i] - 2 * p * tb[i] + p * p * bb[i]) / i
        start, before, m = t[i - 1], b[i - 1], n - i
        q = _exact_period(t[-1] - start, b[-1] - before, 0)
        # (t - start - q (b - before))^2, summed
        shift = q * before - start
        second = (tt[n] - tt[i] - 2 * q * (tb[n] - tb[i]) + q * q * (bb[n] - bb[i]) + 2 * shift * (st[n] - st[i]) - 2 * q * shift * (sb[n] - sb[i])) / m + shift * shift
        if first + second < least - 1e-9:
            best, least = i, first + second
    return best


def red_points(markers: DataFrame, leniency_ms: float = 20.0) -> DataFrame:
    """(track, offset_ms, ms_per_beat, meter): red points for markers (track, time_ms, kind) of beats.

    Kinds are beat, measure and timing_point. Each timing point makes a red point; without any, the first marker does.
    The markers between measures are counted: where their number changes a red point with that meter begins. Then each
    marker must lie within `leniency_ms` of its beat, counted from the red point before it: the roundest period for
    which this holds for all of them is taken; where there is none, a new red point cuts them in two at the measure (or
    last marker) that leaves least squared error. A red point right after another gets the beat count, whole or a half
    to a sixteenth, that the tempo before suggests. A measure out of step with the meter begins a red point as well, also
    before the first one, whose meter the last measure before it tells.

    A track's markers are held by one task; a section, from red point to red point, is judged by running bounds of the
    periods that fit, as arrays. Other kinds and rows without a time don't count.
    """

    def infer(rows: pa.Table) -> pa.Table:
        order = np.argsort(np.array(rows["time_ms"].to_pylist(), "i8"), kind="stable")
        time = np.array(rows["time_ms"].to_pylist(), "i8")[order]
        kind = np.array(rows["kind"].to_pylist(), object)[order]
        points = _metered(time, kind == "timing_point", kind == "measure")
        _fitted(points, time, np.where(kind == "timing_point", 0.0, 1.0), kind == "measure", leniency_ms)
        columns = {"track": [rows["track"][0].as_py()] * len(points), **dict(zip(("offset_ms", "ms_per_beat", "meter"), map(list, zip(*points, strict=True)), strict=True))}
        return pa.table(columns, pa.schema([("track", pa.int64()), ("offset_ms", pa.int64()), ("ms_per_beat", pa.float64()), ("meter", pa.int32())]))

    kept = markers.select("track", "time_ms", "kind").where("time_ms IS NOT NULL AND kind IN ('beat', 'measure', 'timing_point')")
    return kept.groupBy("track").applyInArrow(infer, "track long, offset_ms long, ms_per_beat double, meter int")


#: Red points nearer than this are one; meter and period of those that nothing tells.
FUZZ_MS, METER, PERIOD = 2, 4, 1000.0


def _metered(time: np.ndarray, red: np.ndarray, measure: np.ndarray) -> list[list]:
    """[offset, period, meter] of red points, from timing points and from the number of markers between measures."""
    first = np.unique(time[red]) if red.any() else time[:1]
    first = first[np.r_[True, np.diff(first) > FUZZ_MS]]
    section = np.searchsorted(first, time, "left") - 1  # what stands on a red point belongs to the section before
    inside = ~red & (time != first[0])
    nth = np.cumsum(inside) - np.searchsorted(section[inside], section, "left")  # place in its section, from 1
    at = np.flatnonzero(inside & measure)
    fresh = np.r_[True, np.diff(section[at]) > 0] if len(at) else np.zeros(0, bool)
    count = nth[at] - np.where(fresh, 0, np.r_[0, nth[at][:-1]] if len(at) else 0)
    meters = {int(t): METER for t in first}
    early = section[at] < 0  # before the first point the last measure tells its meter
    meters[int(first[0])] = int(count[early][-1]) if early.any() else METER
    at, fresh, count = at[~early], fresh[~early], count[~early]
    for k in np.flatnonzero(fresh | np.r_[True, np.diff(count) != 0] if len(at) else fresh).tolist():
        start = first[section[at[k]]] if fresh[k] else time[at[k - 1]]
        near = next((t for t in range(int(start) - FUZZ_MS, int(start) + FUZZ_MS + 1) if t in meters), int(start))
        meters[near] = int(count[k])
    return [[t, PERIOD, meters[t]] for t in sorted(meters)]


def _fitted(points: list[list], time: np.ndarray, beats: np.ndarray, measure: np.ndarray, leniency: float) -> None:
    """Periods for red points, and further red points, section by section; `judged` is the last marker known to fit."""

    def begin(k: int, t: int, period: float) -> int:
        """Which point stands at t: k or the next one, if near, which then gets the period, else a new one."""
        for n in (k, k + 1):
            if n < len(points) and abs(points[n][0] - t) <= FUZZ_MS:
                points[n][1] = period
                return n
        points.insert(k + 1, [t, period, points[k][2]])
        return k + 1

    early = np.flatnonzero(time < points[0][0])
    bars = np.flatnonzero(measure[early])
    astray = bars[np.diff(np.r_[-1, bars]) % points[0][2] != 0]
    if len(astray):  # a measure before the first point is out of step with it
        points.insert(0, [int(time[early[astray[0]]]), PERIOD, METER])

    k, judged, stepped, tempo = 0, -1, -1, PERIOD
    while k < len(points):
        offset, _, meter = points[k]
        end = points[k + 1][0] if k + 1 < len(points) else np.inf
        a, b = np.searchsorted(time, offset, "right"), np.searchsorted(time, end, "right")
        if b - a == 1 and not beats[a]:
            guess = (time[a] - offset) / tempo
            beats[a] = min((round(guess), *(0.5**n for n in range(5))), key=lambda x: abs(x - guess))
        own = a + np.flatnonzero(beats[a:b] > 0)
        if not len(own):
            if b - a == 1:  # no beat to the next point
                tempo = PERIOD
                points[k][1] = PERIOD if time[a] - offset <= leniency else points[k][1]
            k += 1
            continue
        gap, count = (time[own] - offset).astype(float), np.cumsum(beats[own])
        low, high = np.maximum.accumulate((gap - leniency) / count), np.minimum.accumulate((gap + leniency) / count)
        exact = np.where(60_000 * count < gap, PERIOD, gap / count)
        off = (own > judged) & ((exact < low - 1e-9) | (exact > high + 1e-9))
        bars = np.flatnonzero(measure[own])
        astray = bars[(np.diff(np.r_[-1, bars]) % meter != 0) & (own[bars] >= judged) & (own[bars] > stepped) & (time[own[bars]] < end)]
        stop = min([*np.flatnonzero(off)[:1].tolist(), *astray[:1].tolist(), len(own) - 1])

        def roundest(i: int) -> float:
            """The roundest period for the section's markers up to i."""
            p = float(exact[i])
            return round_period(60_000.0, 60_000.0 / p, lambda q: low[i] - 1e-9 <= q <= high[i] + 1e-9) if 0 < p <= 60_000 else p

        if off[stop]:
            before, judged = judged, int(own[stop])
            if stop == 0:
                tempo = float(exact[0])
                continue
            allowed = np.r_[False, measure[own[:stop]]]
            allowed[-1] = True
            cut = _best_cut(time[own[: stop + 1]].astype(float), beats[own[: stop + 1]], allowed, offset) or stop
            if cut < stop or own[cut - 1] > before:
                points[k][1] = roundest(cut - 1)
            start = int(time[own[cut - 1]])
            tempo = _exact_period(float(time[own[stop]] - start), float(beats[own[cut : stop + 1]].sum()), leniency)
            k = begin(k, start, tempo)
            continue
        if own[stop] > judged:
            points[k][1] = tempo = roundest(stop)
            judged = int(own[stop])
        stepped = int(own[stop])
        k = begin(k, int(time[own[stop]]), points[k][1]) if stop in astray else k + 1
