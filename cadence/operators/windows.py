"""Window operators over ordered streams. `order` must be a total order within a part; add a sequence column."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cadence.operators.joins import asof
from cadence.operators.ranking import with_running_total


def ordered(part: str | list[str], *order) -> WindowSpec:
    return Window.partitionBy(part).orderBy(*order)


def step_distance(x: Column, y: Column, w: WindowSpec, start: tuple[float, float] = (256.0, 192.0)) -> Column:
    """Distance from the previous point; the first from `start`."""
    return F.hypot(x - F.coalesce(F.lag(x).over(w), F.lit(start[0])), y - F.coalesce(F.lag(y).over(w), F.lit(start[1])))


def changes(df: DataFrame, value: str, w: WindowSpec, initial=None) -> DataFrame:
    """Rows whose value differs from the previous one (from `initial`, or always kept, for the first)."""
    before = F.lag(value).over(w)
    before = F.coalesce(before, F.lit(initial)) if initial is not None else before
    return df.withColumn("_before", before).where(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def carried(value: Column, w: WindowSpec, default, inclusive: bool = False) -> Column:
    """The last non-null value before the row (or at it), else `default`."""
    return F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)), F.lit(default))


def normalized_speeds(points: DataFrame, part: str, time: str, seq: str, is_red: str, value: str, typical: str) -> DataFrame:
    """Scroll speeds relative to the typical beat: last point of each time, only where the speed changes.

    A red point has speed 1 and sets the beat; a green point's value v (negative) means speed -100 / v.
    """
    w = ordered(part, time, seq)
    beat = carried(F.when(F.col(is_red), F.col(value)), w, None, inclusive=True)
    own = F.when(F.col(is_red), F.lit(1.0)).otherwise(F.lit(-100.0) / F.col(value))
    rows = points.withColumn("speed", own * F.col(typical) / F.coalesce(beat, F.col(typical)))
    last = rows.withColumn("_next", F.lead(time).over(w)).where(F.col("_next").isNull() | (F.col("_next") > F.col(time))).drop("_next")
    return changes(last, "speed", w)


def beat_grid(points: DataFrame, part: str, time: str, period: str, meter: str, end: str, before_next: int = 10) -> DataFrame:
    """A row per beat of each red point until `before_next` ms before the next one (the last: until `end`).

    beat counts from 0 at the point; kind is measure every `meter` beats, else beat. Periods must be positive.
    """
    following = F.lead(time).over(ordered(part, time)) - before_next
    stop = F.coalesce(following, F.col(end))
    n = F.floor((stop - F.col(time)) / F.col(period)).cast("int")
    rows = points.withColumn("_n", n).where("_n >= 0").withColumn("beat", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    kind = F.when(F.col("beat") % F.col(meter) == 0, F.lit("measure")).otherwise(F.lit("beat"))
    return rows.select(part, (F.col(time) + F.col("beat") * F.col(period)).cast("long").alias("time"), "beat", kind.alias("kind"))


def histories(df: DataFrame, w: WindowSpec, value: str, length: int, target: Column) -> DataFrame:
    """At target rows that have `length` + 1 rows before them: history (the rows but the last), label (the last)."""
    back = F.collect_list(value).over(w.rowsBetween(-length - 1, -2))
    rows = df.withColumn("history", back).withColumn("label", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return rows.where(target & (F.col("_n") > length + 1)).drop("_n")


def sliding(df: DataFrame, part: str, place: str, length: int, stride: int) -> DataFrame:
    """Rows with the id of each full window (length, stride) that holds them; `place` counts from 0 within a part."""
    sizes = df.groupBy(part).agg((F.max(place) + 1).alias("_size"))
    last = F.floor(F.col(place) / F.lit(stride))
    first = F.greatest(F.ceil((F.col(place) - length + 1) / F.lit(stride)), F.lit(0))
    rows = df.join(sizes, part).withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.where(F.col("window") * stride + length <= F.col("_size")).drop("_size")


def padded_windows(count: Column, length: int, stride: int) -> Column:
    """Array of (window, start) of a signal of `count` samples padded so that windows cover it all."""
    n = F.greatest(F.ceil((count - length) / F.lit(stride)), F.lit(0)).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("window"), (i * stride).alias("start")))


def tumbling(df: DataFrame, place: str, length: int) -> DataFrame:
    return df.withColumn("window", F.floor(F.col(place) / F.lit(length)))


def path_length(distance: Column, w: WindowSpec) -> Column:
    return F.sum(distance).over(w.rowsBetween(Window.unboundedPreceding, 0))


def smoothed(counts: DataFrame, part: str, at: str, value: str, sigma: float, size: str | None = None) -> DataFrame:
    """Sparse counts spread by a normalized Gaussian cut at 4 sigma, at every place they reach.

    With `size`, a column with the number of places of a part, what would fall outside [0, size) is reflected at the
    ends, as if the signal went on mirrored with its end places repeated; without it places have no ends.
    """
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x / sum(raw)).alias("w")) for k, x in zip(range(-reach, reach + 1), raw, strict=True)))
    place = F.col(at) + F.col("_k.k")
    if size:
        turn = F.pmod(place, 2 * F.col(size))
        place = F.least(turn, 2 * F.col(size) - 1 - turn)
    spread = counts.withColumn("_k", F.explode(kernel)).withColumn(at, place)
    return spread.groupBy(part, at).agg(F.sum(F.col(value) * F.col("_k.w")).alias(value))


def timed_events(events: DataFrame, part: str, seq: str, kind: str, value: str, points: list[str], timed: list[str], end: Column, types_first: bool = False) -> DataFrame:
    """`events` with time_ms, the time of every event of a stream that only its `time_shift` events state.

    A time shift's value holds from it on (with `types_first`, from the type event right before it on); before any, the
    time is 0. Control points, the kinds in `points`, lie between the times around them, and other events go with the
    control point before them, as a walk from each part's end to its start meets them (`types_first`: from its start to
    its end). A run of control points ends at a kind in `timed` or a time shift. With c control points from here to the
    walk's next time shift, a point is moved from the time reached so far to c / (c + 1) of the way from that shift's,
    cut to whole milliseconds. Where the walk meets no shift the time is `end` after the last event and 0 before the
    first.
    """
    w = ordered(part, seq)
    so_far, to_go = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    is_shift, is_point = F.col(kind) == "time_shift", F.col(kind).isin(*points)
    shift = F.when(is_shift, F.col(value).cast("long"))
    rows = events.withColumn("_shift", F.lead(shift).over(w) if types_first else shift)
    rows = rows.withColumn("_own", F.coalesce(F.last("_shift", ignorenulls=True).over(so_far), F.lit(0).cast("long")))
    # a walk comes from `back` and goes `ahead`
    back, ahead, near = (so_far, to_go, F.last) if types_first else (to_go, so_far, F.first)
    after = F.first if types_first else F.last
    onward, backward = (F.col(seq).asc(), F.col(seq).desc()) if types_first else (F.col(seq).desc(), F.col(seq).asc())
    mark = F.when(is_shift | F.col(kind).isin(*timed), F.lit(False)).when(is_point, F.lit(True))
    rows = rows.withColumn("_open", F.coalesce(near(mark, ignorenulls=True).over(back), F.lit(False)))
    start = F.first("_own").over(so_far) if types_first else end.cast("long")
    rows = rows.withColumn("_from", F.coalesce(near(F.when(~F.col("_open"), F.col("_own")), ignorenulls=True).over(back), start))
    rows = rows.withColumn("_to", F.coalesce(after(F.when(is_shift, F.col("_own")), ignorenulls=True).over(ahead), end.cast("long") if types_first else F.lit(0).cast("long")))
    rows = rows.withColumn("_run", F.count(F.when(~mark, 1)).over(back)).withColumn("_zone", F.count(F.when(is_shift, 1)).over(ahead))
    count = lambda group, order: F.count(F.when(is_point, 1)).over(Window.partitionBy(part, group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_i", count("_run", onward)).withColumn("_c", count("_zone", backward))

    def moved(now: Column, k: Column) -> Column:
        c = F.col("_c") + F.col("_i") - k
        return ((now - F.col("_to")) / (c + 1) * c + F.col("_to")).cast("long").cast("double")

    own = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_i")), F.col("_from").cast("double"), moved).cast("long")
    rows = rows.withColumn("_x", F.when(is_point, own))
    last = near("_x", ignorenulls=True).over(back)
    return rows.withColumn("time_ms", F.when(F.col("_open"), last).otherwise(F.col("_own"))).drop("_shift", "_own", "_open", "_from", "_to", "_run", "_zone", "_i", "_c", "_x")


def gap_filled(df: DataFrame, part: str, time: str, seq: str) -> DataFrame:
    """Null times placed evenly between the timed rows around them, cut to whole milliseconds.

    Of k untimed rows between two timed ones the i-th lies at i / (k + 1) of the way. Before the first timed row the
    way starts at 0; after the last one rows take its time.
    """
    w = ordered(part, seq)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    t = F.col(time)
    group = F.count(t).over(before)
    rows = df.withColumn("_lo", F.coalesce(F.last(t, ignorenulls=True).over(before), F.lit(0))).withColumn("_hi", F.first(t, ignorenulls=True).over(after))
    rows = rows.withColumn("_g", group).withColumn("_open", t.isNull().cast("int"))
    gap = Window.partitionBy(part, "_g")
    rows = rows.withColumn("_k", F.sum("_open").over(gap)).withColumn("_i", F.sum("_open").over(gap.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))
    hi = F.coalesce("_hi", "_lo")
    filled = (F.col("_lo") + (hi - F.col("_lo")) * F.col("_i") / (F.col("_k") + 1)).cast("long")
    return rows.withColumn(time, F.coalesce(t, filled)).drop("_lo", "_hi", "_g", "_open", "_k", "_i")


def boundary_groups(events: DataFrame, part: str, seq: str, is_head: Column, heads_first: bool) -> DataFrame:
    """`events` with group: rows up to and including a head row (heads last), or from one to before the next.

    Rows that no head closes join the last group; with heads first, rows before the first head join the first one.
    """
    w = ordered(part, seq)
    head = is_head.cast("int")
    so_far = F.sum(head).over(w.rowsBetween(Window.unboundedPreceding, 0 if heads_first else -1))
    total = F.sum(head).over(Window.partitionBy(part))
    raw = F.coalesce(so_far, F.lit(0)) - (1 if heads_first else 0)
    return events.withColumn("group", F.greatest(F.least(raw, total - 1), F.lit(0)))


def beats_between(points: DataFrame, part: str, time: str, period: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    """`spans` with beats: the integral of 1 / period over [start, end], each point's period holding until the next.

    Before a part's first point there are no beats; of points at one time the longest period holds. The integral up to
    each point is a running sum, looked up as of a span's ends, so no span meets more than two points.
    """
    one = points.groupBy(part, F.col(time).alias("_t")).agg(F.max(period).alias("_period"))
    w = ordered(part, "_t")
    before = F.lag(F.struct("_t", "_period")).over(w)
    one = one.withColumn("_step", F.coalesce((F.col("_t") - before["_t"]) / before["_period"], F.lit(0.0)))
    one = one.select(part, "_t", F.struct(F.col("_t").alias("at"), "_period", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum")).alias("_p"))

    def up_to(rows: DataFrame, at: str, name: str) -> DataFrame:
        found = asof(rows.withColumn("_t", F.col(at)), one, part, "_t", ["_p"])
        return found.withColumn(name, F.coalesce(F.col("_p.sum") + (F.col("_t") - F.col("_p.at")) / F.col("_p._period"), F.lit(0.0))).drop("_t", "_p")

    rows = up_to(up_to(spans, start, "_lo"), end, "_hi")
    return rows.withColumn("beats", F.when(F.col(end) > F.col(start), F.col("_hi") - F.col("_lo")).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def counts_between(spans: DataFrame, rows: DataFrame, part: str, time: str, start: str, end: str, bin_col: str, bins: int) -> DataFrame:
    """`spans` with counts: for each bin in [0, bins) how many `rows` of the part lie at start <= time <= end.

    Running counts of each bin are read off at both ends of a span, so no pair of span and row is made. `spans` must
    have columns that tell its rows apart; rows with other bins don't count.
    """
    ends = F.array(F.struct(F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(-1).alias("_sign")), F.struct(F.col(end).alias("_t"), F.lit(2).alias("_side"), F.lit(1).alias("_sign")))
    marks = spans.select(part, F.struct(*spans.columns).alias("_span"), F.inline(ends)).withColumn("_bin", F.lit(None).cast("int"))
    own = rows.select(
        part, F.lit(None).cast(marks.schema["_span"].dataType).alias("_span"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(0).alias("_sign"), F.col(bin_col).cast("int").alias("_bin")
    )
    w = ordered(part, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.unionByName(own)
    swept = swept.select("_span", "_sign", *(F.count(F.when(F.col("_bin") == k, 1)).over(w).alias(f"_c{k}") for k in range(bins))).where("_span IS NOT NULL")
    found = swept.groupBy("_span").agg(*(F.sum(F.col("_sign") * F.col(f"_c{k}")).alias(f"_c{k}") for k in range(bins)))
    return found.select("_span.*", F.array(*(F.col(f"_c{k}") for k in range(bins))).alias("counts"))


def delta_step(time: Column, w: WindowSpec, low: int, per_ms: float, most: int) -> Column:
    """Time since the previous row in steps, halves to even, within 0 and `most`; 0 for the first row.

    Whole times are multiplied by `per_ms` as it is written, in decimals, as halves are no halves any more in binary."""
    step = F.bround((time - F.lag(time).over(w) - low) * F.lit(Decimal(str(per_ms))), 0)
    return F.least(F.greatest(step, F.lit(0)), F.lit(most)).cast("int")


def filled_forward_back(value: Column, w: WindowSpec, typical: Column) -> Column:
    """The last known value, else the next known one, else `typical`."""
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after, typical)


def octave_normalized(tempo: Column, typical: Column, factor: float = 1.5) -> Column:
    """Divided, then multiplied, by whole numbers into [typical / factor, typical * factor]."""
    down = tempo / F.ceil(tempo / (typical * factor))
    return down * F.ceil((typical / factor) / down)


def neighbourhood(df: DataFrame, part: str, place: str, width: int) -> DataFrame:
    """(part, i, j) for rows of a part with |i - j| <= width: each row is sent to the places it reaches."""
    near = df.select(part, F.col(place).alias("i"), F.explode(F.sequence(F.col(place) - width, F.col(place) + width)).alias("j"))
    there = df.select(F.col(part).alias("_part"), F.col(place).alias("_j"))
    return near.join(there, (F.col(part) == F.col("_part")) & (F.col("j") == F.col("_j"))).select(part, "i", "j")


def part_schedule(count: Column, length: int, buffer: int) -> Column:
    """Array of (start, end) of overlapping parts: each starts length - 2 * buffer after the one before."""
    step = length - 2 * buffer
    return F.when(
        count - 2 * buffer > 0,
        F.transform(F.sequence(F.lit(0), count - 2 * buffer - 1, F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(s + length, count).alias("end"))),
    )


def interleaved(splits: DataFrame, split: str, order: str) -> DataFrame:
    """`splits` with round: the place in its split; the order (round, split) takes one of each split in turn. A split of any
    size is numbered by ranges."""
    return with_running_total(splits, split, [order], F.lit(1), "round")


def monotonic(df: DataFrame, part: str, seq: str, time: str) -> DataFrame:
    """Rows whose time is not below any earlier one of their part."""
    highest = F.max(time).over(ordered(part, seq).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_high", highest).where(F.col("_high").isNull() | (F.col(time) >= F.col("_high"))).drop("_high")


def packed_batches(requests: DataFrame, group: str, seq: str, work: str, capacity: int) -> DataFrame:
    """(group, batch, seq, units): requests of a group in order fill batches of `capacity`; a request may be split. A group
    of any size is summed through by ranges."""
    rows = with_running_total(requests.where(F.col(work) > 0), group, [seq], F.col(work), "_end").withColumn("_start", F.col("_end") - F.col(work))
    first, last = F.floor(F.col("_start") / F.lit(capacity)), F.floor((F.col("_end") - 1) / F.lit(capacity))
    rows = rows.withColumn("batch", F.explode(F.sequence(first, last)))
    units = F.least(F.col("_end"), (F.col("batch") + 1) * capacity) - F.greatest(F.col("_start"), F.col("batch") * capacity)
    return rows.select(group, "batch", seq, units.alias("units"))


def trimmed_windows(tokens: DataFrame, track: str, step_ms: int, stride_ms: int, window_ms: int, lookback: float, lookahead: float, types_first: bool = False) -> DataFrame:
    """Events kept of tokens that were generated window by window: (track, window, seq, kind, value, time_ms).

    `tokens` are rows (track, window, seq, kind, value); windows overlap by stride. Of a window what comes from its first
    `eos` on goes. In all but a track's last window, a time shift in the lookahead (a share of the window at its end)
    as the last token goes, as does, with `types_first` and in all but the first window, one in the lookback; with
    `types_first` the type before it goes along. A time shift counts steps from its window's start and is turned into a
    time, which holds for what follows, over windows too (with `types_first`, from the type right before it). Last,
    what lies after the start of the lookahead goes from the end of all but the last window, up to the first event
    that doesn't. Windows depend on one another only by the time that is carried on, so tracks are swept once.
    """
    in_window = Window.partitionBy(track, "window")
    rows = tokens.withColumn("_last", F.col("window") == F.max("window").over(Window.partitionBy(track)))
    is_eos, is_shift = F.col("kind") == "eos", F.col("kind") == "time_shift"
    final = F.max(F.when(~is_eos, F.struct("seq", "kind", "value"))).over(in_window)
    rows = rows.withColumn("_final", final).withColumn("_eos", F.min(F.when(is_eos, F.col("seq"))).over(in_window))
    # shares as they are written: in binary (1 - 0.3) * 86400 is below 60480
    ahead, back = float((1 - Decimal(str(lookahead))) * window_ms), float(Decimal(str(lookback)) * window_ms)
    late = ~F.col("_last") & (F.col("_final.value") >= int(ahead / step_ms))
    early = (F.col("window") > 0) & (F.col("_final.value") < int(back / step_ms)) & F.lit(types_first and lookback > 0)
    cut = (F.col("_final.kind") == "time_shift") & (late | early)
    rows = rows.withColumn("_place", F.row_number().over(in_window.orderBy(F.desc("seq")))).withColumn("_cut", F.coalesce(cut, F.lit(False)))
    # places from the end, of what is left once the last token's own place is known
    end = F.max(F.when(F.col("seq") == F.col("_final.seq"), F.col("_place"))).over(in_window)
    rows = rows.withColumn("_from_end", F.col("_place") - end)
    rows = rows.where(~F.col("_cut") | (F.col("_from_end") >= (2 if types_first else 1)))
    rows = rows.where(F.col("_eos").isNull() | (F.col("seq") < F.col("_eos"))).where(~is_eos)
    start = F.col("window") * stride_ms
    rows = rows.withColumn("value", F.when(is_shift, start + F.col("value") * step_ms).otherwise(F.col("value")))
    inner = in_window.orderBy("seq")
    shift = F.when(is_shift, F.col("value"))
    own = F.lead(shift).over(inner) if types_first else shift
    rows = rows.withColumn("_shift", own).withColumn("_t", F.last("_shift", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    in_time = F.col("_t").isNull() | (F.col("_t") <= start + ahead)
    rows = rows.withColumn("_kept", F.max(F.when(in_time, F.col("seq"))).over(in_window))
    rows = rows.where(F.col("_last") | (F.col("seq") <= F.col("_kept")))
    carried_on = F.last("_t", ignorenulls=True).over(ordered(track, "window", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(track, "window", "seq", "kind", "value", F.coalesce(carried_on, F.lit(0)).cast("long").alias("time_ms"))
