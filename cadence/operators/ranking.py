"""Positions in a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators.selection import selected
from cadence.session import written


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """`df` with each row's 0-based place in the order of `order` (which should be unique; nulls first).

    Rows are range-partitioned, sorted and written once; a row's place is its number within its range, which the write
    keeps, and the count of all ranges before, so rows are shuffled once and no task sees more than its range. An empty
    table gives an empty result.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition, the lower 33 the row's number in it
    ranged = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_range", F.shiftright("_row", 33))
    bases = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (
        ranged.join(F.broadcast(bases), "_range")  # one row a partition
        .withColumn(name, F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base"))
        .drop("_range", "_base", "_row")
    )


def dictionary(df: DataFrame, key: str, order: str, code: str = "code") -> DataFrame:
    """(key, code): codes 0, 1, ... by each key's first appearance in `order`; ties by key; null keys are dropped."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return with_position(first, ["_first", key], code).select(key, code)


def order_statistics(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """(q, value): the value at place floor(n * q) of the sorted values (the last, for q = 1); nulls don't count."""
    rows = df.where(F.col(value).isNotNull()).select(F.lit(0).alias("key"), F.col(value).alias("value"))
    n = rows.count()
    places = [(0, float(q), min(int(n * q), n - 1)) for q in quantiles]
    wanted = df.sparkSession.createDataFrame(places, "key int, q double, place long")
    return selected(rows, wanted).select("q", F.col("value").alias(value))


def with_count_before(df: DataFrame, order: list[str], flag: str, name: str) -> DataFrame:
    """`df` with the number of rows before, in the order of `order`, that have `flag`.

    Rows are range-partitioned, sorted and written; each range is counted through on its own and gets the counts of all
    ranges before, a row a range.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "ranged").withColumn("_range", F.shiftright("_row", 33))
    one = F.col(flag).cast("long")
    bases = ranged.groupBy("_range").agg(F.sum(one).alias("_n"))
    bases = bases.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    before = F.coalesce(F.sum(one).over(Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = ranged.withColumn("_before", before).join(F.broadcast(bases), "_range")  # one row a partition
    return counted.withColumn(name, F.col("_before") + F.col("_base")).drop("_before", "_base", "_range", "_row")


def with_running_total(df: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` (a long; null: 0) over its group's rows up to and with its own, in the order of `order`.

    `order` should be unique in a group; a null group is a group. Rows are range-partitioned by group and order and
    written, so a group of any size is dealt out over ranges, and a range is summed through on its own. A range can
    only owe something to its first group, so what earlier ranges hand over is one row a range.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [group, *order]
    ranged = df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # the upper bits of this id are the partition, the lower 33 the row's number in it
    ranged = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "ranged").withColumn("_range", F.shiftright("_row", 33))
    ends = ranged.groupBy("_range").agg(
        F.min_by(F.struct(group), "_row").alias("_first"), F.max_by(F.struct(group), "_row").alias("_last"), F.min("_row").alias("_start")
    )
    # of each range's first and last group: what it holds of them
    held = ranged.join(F.broadcast(ends.select("_range", "_first", "_last")), "_range")  # one row a range
    sum_of = lambda end: F.sum(F.when(F.struct(group).eqNullSafe(F.col(end)), F.col("_value")).otherwise(0))
    sums = held.groupBy("_range", "_first", "_last").agg(sum_of("_first").alias("_sum_first"), sum_of("_last").alias("_sum_last"))
    rows = sums.select("_range", F.col("_first").alias("_key"), F.lit(True).alias("_leads"), F.col("_sum_first").alias("_sum"))
    rows = rows.unionByName(
        sums.where(~F.col("_first").eqNullSafe(F.col("_last"))).select("_range", F.col("_last").alias("_key"), F.lit(False).alias("_leads"), F.col("_sum_last").alias("_sum"))
    )
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_leads").select("_range", "_key", "_base")
    inside = Window.partitionBy("_range", group).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum("_value").over(inside)).join(F.broadcast(bases), "_range")  # one row a range
    owed = F.when(F.struct(group).eqNullSafe(F.col("_key")), F.col("_base")).otherwise(0)
    return summed.withColumn(name, F.col("_inside") + owed).drop("_value", "_row", "_range", "_inside", "_key", "_base")
