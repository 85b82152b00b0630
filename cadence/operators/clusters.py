"""Cutting long keys where nothing reaches across, so that walks over a key's rows are dealt out over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a cluster, about: as many as a walk takes at once.
ROWS = 20_000


def clusters(df: DataFrame, key: str, time: str, gap: int, rows: int | None = None, may_start: Column | None = None) -> DataFrame:
    """`df` with `_cluster`: neighbours of a key in different clusters are more than `gap` apart in `time`.

    Times go to buckets of `gap`; where at least one bucket between two is empty, a key may be cut, and it is cut about
    every `rows` rows (ROWS). `may_start`, an aggregate over a bucket's rows, says whether a cluster may start there. Only
    a row a bucket is windowed by key. Null keys are one key; rows with a null time have the null cluster.
    """
    rows = rows or ROWS
    bucket = F.floor(F.col(time) / F.lit(gap))
    filled = df.where(F.col(time).isNotNull()).groupBy(F.col(key).alias("_of"), bucket.alias("_in")).agg(F.count("*").alias("_n"), (F.lit(True) if may_start is None else may_start).alias("_may"))
    order = Window.partitionBy("_of").orderBy("_in")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = filled.withColumn("_before", before).withColumn("_far", F.col("_in") - F.lag("_in").over(order) > 1)
    start = F.when(F.col("_far").isNull() | (F.col("_far") & F.col("_may")), F.col("_before"))
    filled = filled.withColumn("_start", start)
    filled = filled.withColumn("_cluster", F.floor(F.last("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(rows)))
    same = F.col(key).eqNullSafe(F.col("_of")) & (bucket == F.col("_in"))
    return df.join(filled.select("_of", "_in", "_cluster"), same, "left").drop("_of", "_in")
