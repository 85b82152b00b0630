"""Exact selection: the values at given places of a key's sorted values, without sorting them.

Each round counts values in BINS equal parts of the range that still holds a place, keeps each part's least and
greatest value, and goes on with the part that holds the place. A part of one value, or of few, ends the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadence.session import written

#: Parts of a range in a round, and values that one task sorts.
BINS, FEW = 1024, 100_000
_MOST = 1.7976931348623157e308


def selected(rows: DataFrame, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """(key, q, value): for rows (key, value) of numbers and wanted (key, q, place), places from 0.

    `wanted` has few rows. Null keys are one key; null values and wanted places outside a key's values don't count;
    NaN is greater than any number. A round is one aggregate over the rows of wanted keys that are still in question.
    """
    rows = rows.select("key", "value").where("value IS NOT NULL")
    same = lambda a, b: F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))
    keys = wanted.select("key").distinct()
    ends = rows.alias("r").join(F.broadcast(keys).alias("w"), same("r", "w"), "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = wanted.alias("w").join(ends.alias("e"), same("w", "e")).where("place >= 0 AND place < n").select("w.key", "q", "place", "n", "lo", "hi")
    state = written(state, "selection")
    while not state.where(f"lo <> hi AND n > {few}").isEmpty():
        state = written(_narrowed(rows, state, few), "selection")
    held = rows.alias("r").join(F.broadcast(state.where("lo <> hi")).alias("s"), same("r", "s") & F.col("r.value").between(F.col("lo"), F.col("hi")))
    held = held.groupBy("s.key", "q", "place").agg(F.sort_array(F.collect_list("value")).alias("values"))
    last = held.select("key", "q", F.get("values", F.col("place").cast("int")).alias("value"))
    return state.where("lo = hi").select("key", "q", F.col("lo").alias("value")).unionByName(last)


def _narrowed(rows: DataFrame, state: DataFrame, few: int) -> DataFrame:
    """The state after a round: for each place in question the part that holds it and the place within."""
    open_ = state.where(f"lo <> hi AND n > {few}").select(F.col("key").alias("of"), "q", "place", "lo", "hi")
    inside = rows.join(F.broadcast(open_), F.col("key").eqNullSafe(F.col("of")) & F.col("value").between(F.col("lo"), F.col("hi")))
    counts = inside.groupBy("of", "q", "place", _part(isinstance(rows.schema["value"].dataType, (T.FloatType, T.DoubleType))).alias("part"))
    counts = counts.agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    order = Window.partitionBy("of", "q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    found = counts.where("place >= before AND place < before + n").select(F.col("of").alias("key"), "q", (F.col("place") - F.col("before")).alias("place"), "n", "lo", "hi")
    return state.where(f"lo = hi OR n <= {few}").unionByName(found)


def _part(floating: bool) -> Column:
    """Which part of lo to hi a value is in; lo and hi, where they differ, are always in different ones."""
    v, lo, hi = (F.col(c) for c in ("value", "lo", "hi"))
    if not floating:
        exact = lambda x: (x.cast("decimal(38,6)") - lo.cast("decimal(38,6)")).cast("double")
        return F.least(F.floor(F.coalesce(F.try_divide(exact(v), exact(hi)), F.lit(0.0)) * BINS), F.lit(BINS - 1))
    # infinities and NaN have parts of their own; halves, so that the width of any range is a number
    number = lambda x: F.greatest(F.least(F.nanvl(x.cast("double"), F.lit(_MOST)), F.lit(_MOST)), F.lit(-_MOST)) / 2
    v, lo, hi = number(v), number(lo), number(hi)
    # a range over many magnitudes is cut by magnitude first
    magnitude = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log(F.abs(x)) + 750))
    wide = (F.signum(lo) != F.signum(hi)) | (F.greatest(F.abs(lo), F.abs(hi)) > BINS * F.least(F.abs(lo), F.abs(hi)))
    v, lo, hi = (F.when(wide, magnitude(x)).otherwise(x) for x in (v, lo, hi))
    part = F.least(F.floor(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)) * BINS), F.lit(BINS - 1))
    odd = F.when(F.isnan("value"), BINS + 1).when(F.col("value") == float("inf"), BINS).when(F.col("value") == float("-inf"), -1)
    return F.coalesce(odd.cast("long"), part)
