"""Peaks of signals and walks from peak to peak.

A signal is sparse: its rows are runs of samples, and what lies between is a run of zeros, however long. Tracks are cut
where the signal is silent for longer than anything reaches (clusters.py), so a long track is several groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.clusters import clusters

#: Queries of one track that are searched by one task.
QUERIES = 100_000


class Runs:
    """A signal as runs of equal samples: first and last place and value of each; zero where nothing is given."""

    def __init__(self, place: np.ndarray, value: np.ndarray, quiet: int = 1):
        """Values of a place add up, negative sums count as zero; `quiet` samples of silence come before and one after,
        as far as places aren't negative."""
        at, which = np.unique(place, return_inverse=True)
        v = np.maximum(np.bincount(which, weights=value, minlength=len(at)), 0.0)
        lead = max(0, int(at[0]) - quiet)
        edges = np.concatenate([[lead - 1], at, [at[-1] + 2]])
        gaps = np.flatnonzero(np.diff(edges) > 1)  # silence after edge k, up to the next one
        first = np.concatenate([at, edges[gaps] + 1])
        last = np.concatenate([at, edges[gaps + 1] - 1])
        values = np.concatenate([v, np.zeros(len(gaps))])
        order = np.argsort(first, kind="stable")
        first, last, values = first[order], last[order], values[order]
        heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        self.first, self.value = first[heads], values[heads]
        self.last = np.r_[last[heads[1:] - 1], last[-1]]
        self.lows = [self.value]
        while (half := 1 << (len(self.lows) - 1)) * 2 <= len(self.value):
            self.lows.append(np.minimum(self.lows[-1][:-half], self.lows[-1][half:]))

    def lowest(self, a: int, b: int) -> float:
        """The least value of runs a to b."""
        k = (b - a + 1).bit_length() - 1
        return min(self.lows[k][a], self.lows[k][b - (1 << k) + 1])

    def higher(self) -> tuple[list[int], list[int]]:
        """For each run the next higher one before and after it, -1 and their number if there is none."""
        before, after, stack = [-1] * len(self.value), [len(self.value)] * len(self.value), []
        for i, v in enumerate(self.value.tolist()):
            while stack and self.value[stack[-1]] < v:
                after[stack.pop()] = i
            # what is left is as high or higher; an equal one is no bound, but its own bound is
            before[i] = -1 if not stack else (stack[-1] if self.value[stack[-1]] > v else before[stack[-1]])
            stack.append(i)
        return before, after

    def summits(self) -> np.ndarray:
        """Runs that are higher than the runs on both sides."""
        v = self.value
        return np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1

    def crossing(self, run: int, height: float, way: int) -> tuple[float, float]:
        """Where the signal, from a run on, first comes down to a height: the sample there and the share of the way back."""
        k = run + way
        while self.value[k] > height:
            k += way
        at, inner = (self.last[k], self.value[k + 1]) if way < 0 else (self.first[k], self.value[k - 1])
        return float(at), (height - self.value[k]) / (inner - self.value[k])


def apart(place: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of some ascending places are kept so that all are `distance` apart: the highest first, then the earliest.

    A kept place takes its neighbours out of a linked list, so each is looked at once or twice.
    """
    n = len(place)
    left, right, gone = list(range(-1, n - 1)), list(range(1, n + 1)), np.zeros(n, bool)
    for i in np.lexsort((place, -height)).tolist():
        if gone[i]:
            continue
        a, b = left[i], right[i]
        while a >= 0 and place[i] - place[a] < distance:
            gone[a], a = True, left[a]
        while b < n and place[b] - place[i] < distance:
            gone[b], b = True, right[b]
        left[i], right[i] = a, b
        if a >= 0:
            right[a] = i
        if b < n:
            left[b] = i
    return ~gone


def peaks(place: np.ndarray, value: np.ndarray, distance: int, prominence: float, reach: int | None, width: float = 0.0, share: float = 1.0) -> pd.DataFrame:
    """(place, prominence, width) of a signal's peaks, by place.

    Peaks are higher than what is next to them (the middle of a level top counts), at least `distance` apart, the higher
    ones first, and stand at least `prominence` over the higher of the lowest samples on both sides, looked for up to a
    higher sample and at most `reach` away. The width, at least `width`, is taken `share` of the prominence below.
    """
    runs = Runs(place, value, (reach or 0) + 1)
    tops = runs.summits()
    middle = (runs.first[tops] + runs.last[tops]) // 2
    kept = apart(middle, runs.value[tops], distance)
    before, after = runs.higher()
    found = []
    for run, at in zip(tops[kept].tolist(), middle[kept].tolist(), strict=True):
        lo, hi = before[run] + 1, after[run] - 1
        if reach is not None:
            lo = max(lo, bisect_left(runs.last, at - reach))
            hi = min(hi, bisect_right(runs.first, at + reach) - 1)
        v = runs.value[run]
        foot = max(runs.lowest(lo, run), runs.lowest(run, hi))
        over = v - foot
        if over < prominence or over <= 0:
            continue
        # the foot itself, not v - over: that can be a bit below the lowest sample, where nothing comes down to it
        height = foot if share == 1 else max(foot, v - share * over)
        (end, over_end), (start, over_start) = runs.crossing(run, height, 1), runs.crossing(run, height, -1)
        wide = end - over_end - start - over_start
        if wide >= width:
            found.append((at, over, wide))
    return pd.DataFrame(found, columns=["place", "prominence", "width"]).astype({"place": "int64", "prominence": float, "width": float})


def find_peaks(signals: DataFrame, distance: int = 50, prominence: float = 0.1, reach: int | None = 25, width: float = 0.0, share: float = 1.0) -> DataFrame:
    """(track, place, prominence, width) from rows (track, place, value), places from 0 on; see peaks().

    Places without a row are zero. Rows with a null place or value don't count. Without `reach` a track is one group.
    """
    rows = signals.select("track", "place", "value").where("place >= 0 AND value IS NOT NULL")
    rows = rows.withColumn("_cluster", F.lit(0)) if reach is None else clusters(rows, "track", "place", max(distance, reach) + 2)

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        found = peaks(group["place"].to_numpy("i8"), group["value"].to_numpy(float), distance, prominence, reach, width, share)
        found.insert(0, "track", group["track"].iloc[0])
        return found

    return rows.groupBy("track", "_cluster").applyInPandas(scan, "track long, place long, prominence double, width double")


class Envelope:
    """Which of some places has the least distance over height, for any time: the lower envelope of V-shaped lines.

    A line wins on an interval around its place against any that is not steeper, so lines are put in from the flattest
    to the steepest; each takes its interval from those there, and a time's winner is found by binary search.
    """

    def __init__(self, place: np.ndarray, height: np.ndarray):
        self.place, self.height = np.asarray(place, float), np.asarray(height, float)
        cuts: list[float] = []
        owner: list[int] = []
        for i in np.lexsort((self.place, -self.height)).tolist():
            if not owner:
                owner.append(i)
                continue
            k = bisect_right(cuts, self.place[i])
            if self.place[owner[k]] == self.place[i] or (k and self.place[owner[k - 1]] == self.place[i]):
                continue
            a = b = k
            while (start := self._bounds(i, owner[a])[0]) <= (cuts[a - 1] if a else -np.inf) and a:
                a -= 1
            while (end := self._bounds(i, owner[b])[1]) >= (cuts[b] if b < len(cuts) else np.inf) and b < len(cuts):
                b += 1
            pieces, edges = [i], []
            if start > (cuts[a - 1] if a else -np.inf):
                pieces, edges = [owner[a], *pieces], [start]
            if end < (cuts[b] if b < len(cuts) else np.inf):
                pieces, edges = [*pieces, owner[b]], [*edges, end]
            owner[a : b + 1] = pieces
            cuts[a:b] = edges
        self.cuts, self.owner = np.array(cuts), np.array(owner, int)

    def _bounds(self, i: int, j: int) -> tuple[float, float]:
        """Between which times line i is not above a flatter line j."""
        p, q, g, h = self.place[i], self.place[j], self.height[i], self.height[j]
        inner = (p * h + q * g) / (g + h)
        outer = (p * h - q * g) / (h - g) if h > g else np.copysign(np.inf, p - q)
        return (inner, outer) if q < p else (outer, inner)

    def nearest(self, times: np.ndarray) -> np.ndarray:
        """The winner at each time, the earliest place of equal ones at a cut."""
        k = np.searchsorted(self.cuts, times, "right")
        near = self.owner[np.clip(k[:, None] + [-1, 0, 1], 0, len(self.owner) - 1)]
        loss = np.abs(self.place[near] - times[:, None]) / self.height[near]
        earliest = np.where(loss == loss.min(axis=1, keepdims=True), self.place[near], np.inf).argmin(axis=1)
        return near[np.arange(len(times)), earliest]


def nearest_by_loss(queries: DataFrame, peaks_: DataFrame) -> DataFrame:
    """(track, id, place): for each query (track, id, time_ms) the peak (track, place, prominence) with the least distance
    over prominence, the earliest of equal ones. Queries of tracks without peaks go, as do those without a time and
    peaks that don't stand out.

    A track's queries beyond QUERIES go to several groups by id, each with all the track's peaks.
    """
    queries = queries.select("track", "id", "time_ms").where("time_ms IS NOT NULL")
    many = queries.groupBy("track").agg(F.expr(f"(count(*) - 1) div {QUERIES} + 1").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    queries = queries.join(F.broadcast(many), "track", "left").withColumn("_part", F.pmod(F.xxhash64("id"), parts)).drop("_parts")
    each = peaks_.select("track", "place", "prominence").where("prominence > 0 AND place IS NOT NULL").join(F.broadcast(many), "track", "left")
    each = each.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")

    none = F.lit(None)
    asked = queries.select("track", "_part", F.col("id").cast("long").alias("id"), F.col("time_ms").cast("long").alias("at"), none.cast("double").alias("height"))
    rows = asked.unionByName(each.select("track", "_part", none.cast("long").alias("id"), F.col("place").cast("long").alias("at"), F.col("prominence").cast("double").alias("height")))

    def search(rows: pa.Table) -> pa.Table:
        left, right = rows.filter(pc.field("height").is_null()), rows.filter(pc.field("height").is_valid())
        if not len(left) or not len(right):
            return pa.table({"track": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "place": pa.array([], pa.int64())})
        place = right["at"].to_numpy()
        best = Envelope(place, right["height"].to_numpy()).nearest(left["at"].to_numpy().astype(float))
        return pa.table({"track": left["track"], "id": left["id"], "place": pa.array(place[best], pa.int64())})

    return rows.groupBy("track", "_part").applyInArrow(search, "track long, id long, place long")


class Spans:
    """A union of closed intervals, kept apart and in order."""

    def __init__(self):
        self.starts: list[float] = []
        self.ends: list[float] = []

    def __contains__(self, t: float) -> bool:
        k = bisect_right(self.starts, t) - 1
        return k >= 0 and t <= self.ends[k]

    def add(self, start: float, end: float) -> None:
        if start > end:
            return
        a, b = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [start], [end]


def beat_walk(peaks_: DataFrame, near: float = 60.0, doubtful: float = 300.0, margin: int = 200) -> DataFrame:
    """(track, beat_ms): beats that lie a period apart, found outwards from the most prominent peaks.

    Rows are (track, place, prominence, period_ms, sure, length_ms). From a beat the next one is expected a period
    later (earlier), and the peak with the least distance over prominence is asked: within `near` the beat is there,
    and its period counts from then on; within `doubtful` of a sure peak the beats end, as those of another tempo begin;
    else the beat is where it was expected. Beats also end outside 0 to length_ms, at beats already found and where they
    don't go on. What lies between the ends, and `margin` around, isn't entered again, nor do its peaks start beats.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["prominence"] > 0].sort_values(["place"])
        place, height, period = (rows[c].to_numpy(float) for c in ("place", "prominence", "period_ms"))
        sure, length = rows["sure"].to_numpy(bool), float(rows["length_ms"].max()) if len(rows) else 0.0
        ask, found, beats = Envelope(place, height) if len(rows) else None, Spans(), set()

        def following(t: float, step: float) -> tuple[float, float] | None:
            """The beat a (signed) step after t and the step from there; None where another tempo's beats begin."""
            expected = t + step
            k = int(ask.nearest(np.array([expected]))[0])
            loss = abs(place[k] - expected) / height[k]
            if 0 <= expected < length and loss < near:
                return place[k], np.copysign(period[k], step)
            return None if 0 <= expected < length and loss < doubtful and sure[k] else (expected, step)

        def outwards(t: float, step: float) -> float:
            """Add the beats from t on; where they end."""
            while after := following(t, step):
                forward = (after[0] - t) * step > 0
                t, step = after
                if not 0 <= t < length or not forward or t in found:
                    return t
                beats.add(int(t))
            return t

        for k in np.lexsort((place, -height)).tolist():
            if place[k] not in found:
                beats.add(int(place[k]))
                late, early = outwards(place[k], period[k]), outwards(place[k], -period[k])
                found.add(place[k] - margin, late + margin)
                found.add(early - margin, place[k] + margin)
        return pd.DataFrame({"track": rows["track"].iloc[0] if len(rows) else 0, "beat_ms": sorted(beats)})

    return peaks_.groupBy("track").applyInPandas(walk, "track long, beat_ms long")
