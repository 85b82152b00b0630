"""Chart assembly: decoded groups to hit-object lines, and hit objects to feature vectors. All by windows and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators.windows import ordered

#: Type bits of hit objects, curve letters of anchors.
TYPE_BITS = {"circle": 1, "slider": 2, "spinner": 12, "hold": 128}
#: Groups of a task, on average; charts are not split.
GROUPS = 200_000
CURVES = {"bezier_anchor": "B", "perfect_anchor": "P", "catmull_anchor": "C", "red_anchor": "B", "last_anchor": "B"}


def _whole(c: Column) -> Column:
    return F.bround(c.cast("double"), 0).cast("long").cast("string")


def spans(groups: DataFrame, start: str, end: str) -> DataFrame:
    """(chart, seq, start_group, end_group): each end of a kind with the last start before it, if no other end took it."""
    rows = groups.where(F.col("type").isin(start, end))
    before = F.lag(F.struct(*groups.columns)).over(ordered("chart", "seq"))
    rows = rows.withColumn("_b", before).where((F.col("type") == end) & (F.col("_b.type") == start))
    return rows.select("chart", "seq", F.col("_b").alias("start_group"), F.struct(*groups.columns).alias("end_group"))


def hit_object_lines(groups: DataFrame) -> DataFrame:
    """(chart, seq, text) from groups (chart, seq, type, time, x, y, new_combo, hitsound, sample_set, addition).

    Types are circle, hold and hold_end, spinner and spinner_end, slider_head, anchors (CURVES) and slider_end. Missing
    positions take those of the group before. A slider needs a last anchor, whose first one gives the place and whose
    last one gives the time of one span, and positive durations; its repeats are whole spans. Incomplete ones go.
    Charts are dealt to tasks by the number of groups: the sorts of a task are open at once, and a number of partitions
    that goes by compressed bytes lets them grow with the input.
    """
    groups = groups.repartition(max(1, -(-groups.count() // GROUPS)), "chart")
    carry = lambda c, d: F.coalesce(F.last(c, ignorenulls=True).over(ordered("chart", "seq").rowsBetween(Window.unboundedPreceding, 0)), F.lit(d))
    rows = groups.withColumn("x", carry("x", 256.0)).withColumn("y", carry("y", 192.0))
    for c in ("hitsound", "sample_set", "addition"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))
    combo = lambda bits, flag: (F.lit(bits) + F.when(F.coalesce(flag, F.lit(False)), 4).otherwise(0)).cast("string")
    sample = lambda g: F.concat(g("sample_set").cast("string"), F.lit(":"), g("addition").cast("string"), F.lit(":0:0:"))

    circles = rows.where("type = 'circle'").select(
        "chart", "seq",
        F.concat_ws(",", _whole(F.col("x")), _whole(F.col("y")), _whole(F.col("time")), combo(1, F.col("new_combo")), F.col("hitsound").cast("string"), sample(F.col)).alias("text"),
    )
    s, e = (lambda c: F.col(f"start_group.{c}")), (lambda c: F.col(f"end_group.{c}"))
    holds = spans(rows, "hold", "hold_end").select(
        "chart", "seq",
        F.concat_ws(",", _whole(s("x")), F.lit("192"), _whole(s("time")), F.lit("128"), s("hitsound").cast("string"), F.concat(_whole(e("time")), F.lit(":"), sample(s))).alias("text"),
    )
    spinners = spans(rows, "spinner", "spinner_end").select(
        "chart", "seq", F.concat_ws(",", F.lit("256"), F.lit("192"), _whole(s("time")), F.lit("12"), e("hitsound").cast("string"), _whole(e("time")), sample(e)).alias("text")
    )
    return circles.unionByName(holds).unionByName(spinners).unionByName(_sliders(rows, combo, sample))


def _sliders(rows: DataFrame, combo, sample) -> DataFrame:
    parts = rows.where(F.col("type").isin("slider_head", "slider_end", *CURVES))
    head = F.sum((F.col("type") == "slider_head").cast("int")).over(ordered("chart", "seq").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_s", head).where("_s > 0")
    first_end = F.min(F.when(F.col("type") == "slider_end", F.col("seq"))).over(Window.partitionBy("chart", "_s"))
    first_last = F.min(F.when(F.col("type") == "last_anchor", F.col("seq"))).over(Window.partitionBy("chart", "_s"))
    parts = parts.withColumn("_end", first_end).withColumn("_last", first_last).where("seq <= _end")
    place = F.concat_ws(":", _whole(F.col("x")), _whole(F.col("y")))
    own = F.when(F.col("type") == "red_anchor", F.concat_ws("|", place, place)).otherwise(place)
    used = F.col("type").isin(*CURVES) & ((F.col("type") != "last_anchor") | (F.col("seq") == F.col("_last")))
    letter = F.element_at(F.create_map(*(F.lit(v) for kv in CURVES.items() for v in kv)), F.col("type"))
    pick = lambda kind, c: F.max(F.when(F.col("type") == kind, c))
    built = parts.groupBy("chart", "_s").agg(
        F.min_by(F.struct("x", "y", "time", "new_combo", "hitsound", "sample_set", "addition", "seq"), F.when(F.col("type") == "slider_head", F.col("seq"))).alias("h"),
        pick("last_anchor", F.col("time")).alias("last"), pick("slider_end", F.col("time")).alias("stop"),
        F.sort_array(F.collect_list(F.when(used, F.struct("seq", own.alias("p"), letter.alias("k"))))).alias("a"),
    )
    span, total = F.col("last") - F.col("h.time"), F.col("stop") - F.col("h.time")
    built = built.where((span > 0) & (total > 0))
    curve = F.concat_ws("|", F.col("a")[0]["k"], F.array_join(F.transform("a", lambda p: p["p"]), "|"))
    h = lambda c: F.col(f"h.{c}")
    text = F.concat_ws(
        ",", _whole(h("x")), _whole(h("y")), _whole(h("time")), combo(2, h("new_combo")), h("hitsound").cast("string"), curve,
        F.greatest(F.bround(total / span, 0), F.lit(1)).cast("long").cast("string"), _whole(span), sample(h),
    )
    return built.select("chart", h("seq").alias("seq"), text.alias("text"))


def datapoints(objects: DataFrame, kinds: list[str], low=(-256.0, -256.0), high=(768.0, 640.0)) -> DataFrame:
    """(chart, seq, features): clipped x and y, the time, then a one-hot over `kinds`; unknown kinds have all zeros."""
    clip = lambda c, i: F.least(F.greatest(F.col(c).cast("double"), F.lit(low[i])), F.lit(high[i]))
    hot = F.transform(F.array(*map(F.lit, kinds)), lambda k: (F.col("kind") == k).cast("double"))
    return objects.select("chart", "seq", F.concat(F.array(clip("x", 0), clip("y", 1), F.col("time_ms").cast("double")), F.transform(hot, lambda v: F.coalesce(v, F.lit(0.0)))).alias("features"))
