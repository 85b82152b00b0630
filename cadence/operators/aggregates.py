"""Aggregates over catalogues, streams and predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators.selection import FEW, selected
from cadence.session import written

#: Rows of partial moments that reach the driver at most.
MERGED = 64


def upper_median(df: DataFrame, key: str, value: str, few: int = FEW) -> DataFrame:
    """(key, upper_median): the element at floor(n / 2) of each key's sorted non-null values; null keys are one key.

    Keys of up to `few` values are sorted as groups; those of more, counted first, are searched by selection, which
    neither sorts nor gathers their values. Both give the same.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > few)
    many = written(many.select("key", F.lit(0.5).alias("q"), F.floor(F.col("n") / 2).alias("place")), "many")
    middle = lambda rows: rows.groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("_all"))
    none = many.isEmpty()
    small = rows if none else rows.alias("r").join(many.alias("m"), F.col("r.key").eqNullSafe(F.col("m.key")), "left_anti")
    found = middle(small).select("key", F.get("_all", F.floor(F.size("_all") / 2).cast("int")).alias("value"))
    if not none:
        found = found.unionByName(selected(rows, many, few).select("key", "value"))
    return found.select(F.col("key").alias(key), F.col("value").alias("upper_median"))


def most_frequent(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of every key with the greatest count, ties included; counted first, so the maximum is over few rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("n"))), "n").select(key, "n")


def closed_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin in [low, high], the last bin closed; null outside."""
    place = F.floor((x - F.lit(float(low))) / F.lit((high - low) / bins)).cast("int")
    return F.when(x.between(low, high), F.least(place, F.lit(bins - 1)))


def digitized(x: Column, edges: list[float]) -> Column:
    """i with edges[i-1] <= x < edges[i]; 0 below the first edge, len(edges) from the last on."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x))


def mean_one(df: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """`value` clipped, then divided by its mean; the mean is one row joined back."""
    x = F.col(value)
    x = F.greatest(x, F.lit(low)) if low is not None else x
    x = F.least(x, F.lit(high)) if high is not None else x
    rows = df.withColumn(value, x)
    return rows.join(F.broadcast(rows.agg(F.avg(value).alias("_mean")))).withColumn(value, F.col(value) / F.col("_mean")).drop("_mean")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def exactly(contexts: Column, wanted: list[str], of: list[str]) -> Column:
    """Whether, among the names `of`, an array holds all of `wanted` and none of the rest."""
    inside = F.size(F.array_intersect(contexts, F.array(*map(F.lit, wanted)))) == len(wanted)
    rest = [x for x in of if x not in wanted]
    return inside & ~F.arrays_overlap(contexts, F.array(*map(F.lit, rest))) if rest else inside


def moments(df: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sample covariance of arrays of `dims` numbers; null arrays don't count.

    One pass over Arrow batches: each partition sends its count, mean and products of deviations, which are merged in
    tasks to MERGED rows at most; only those, a fixed number, reach the driver.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    schema = "part long, n long, mean array<double>, dev array<double>"

    def merge(a, b):
        """Two (n, mean, products of deviations) as one."""
        n = a[0] + b[0]
        if not b[0]:
            return a
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)

    nothing = 0, np.zeros(dims), np.zeros((dims, dims))

    def as_row(part: int, m) -> dict:
        return {"part": [part], "n": [m[0]], "mean": [m[1].tolist()], "dev": [m[2].ravel().tolist()]}

    def of(n, mean, dev):
        return n, np.array(mean, float), np.array(dev, float).reshape(dims, dims)

    def measure(batches):
        from pyspark import TaskContext

        total = nothing
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, dims)
            if len(x):
                mean = x.mean(axis=0)
                total = merge(total, (len(x), mean, (x - mean).T @ (x - mean)))
        yield pa.RecordBatch.from_pydict(as_row(TaskContext.get().partitionId(), total))

    def merged(rows: pa.Table) -> pa.Table:
        total = nothing
        for n, mean, dev in zip(rows["n"].to_pylist(), rows["mean"], rows["dev"], strict=True):
            total = merge(total, of(n, mean.as_py(), dev.as_py()))
        return pa.table(as_row(0, total))

    parts = rows.mapInArrow(measure, schema).where("n > 0").groupBy(F.pmod("part", F.lit(MERGED))).applyInArrow(merged, schema).collect()
    n, mean, dev = nothing
    for p in sorted(parts, key=lambda p: (p.n, p.mean)):
        n, mean, dev = merge((n, mean, dev), of(p.n, p.mean, p.dev))
    return n, mean if n else np.full(dims, np.nan), dev / (n - 1) if n > 1 else np.full((dims, dims), np.nan)


def frechet(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], eps: float = 1e-6) -> float:
    """Squared Frechet distance of two normal distributions (mean, covariance).

    The trace of the root of S1 S2 is the sum of the roots of its eigenvalues, which are those of a symmetric matrix
    R S2 R with R the root of S1. `eps` is added to both diagonals if a covariance isn't of full rank.
    """
    (m1, s1), (m2, s2) = first, second
    if min(np.linalg.matrix_rank(s1), np.linalg.matrix_rank(s2)) < len(m1):
        s1, s2 = s1 + eps * np.eye(len(m1)), s2 + eps * np.eye(len(m1))
    values, vectors = np.linalg.eigh(s1)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ s2 @ root), 0, None)).sum()
    return float((m1 - m2) @ (m1 - m2) + np.trace(s1) + np.trace(s2) - 2 * cross)


def dominant_period(points: DataFrame, key: str, time: str, period: str, end: str) -> DataFrame:
    """(key, period): the period that holds for the longest time, summed, until each key's `end`.

    A point holds until the next one; the first point holds from time 0; points after the end don't count. Of equally
    long periods the one that ends last wins. Non-positive totals don't count.
    """
    order = Window.partitionBy(key).orderBy(time)
    rows = points.where(F.col(time) <= F.col(end))
    start = F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.col(time))
    rows = rows.withColumn("_len", F.coalesce(F.lead(time).over(order), F.col(end)) - start)
    sums = rows.groupBy(key, period).agg(F.sum("_len").alias("_len"), F.max(time).alias("_last")).where("_len > 0")
    return sums.groupBy(key).agg(F.max_by(period, F.struct("_len", "_last")).alias(period))


def gap_sum(df: DataFrame, key: str, time: str, longest: int) -> DataFrame:
    """(key, total): sum of gaps between successive times that are shorter than `longest`."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time))
    return df.withColumn("_gap", gap).groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("_gap") < longest, F.col("_gap"))), F.lit(0)).alias("total"))


def latest(df: DataFrame, run: str, name: str, value: str, line: str, names: list[str]) -> DataFrame:
    """One row per run, one column per metric: its value on the last line that has it."""
    return df.groupBy(run).agg(*(F.max_by(value, F.when(F.col(name) == x, F.col(line))).alias(x) for x in names))


def loss_weights(df: DataFrame, key: str, loss: str, order: str, last: int = 10) -> DataFrame:
    """(key, weight): root mean square of each key's last losses, made to sum to one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = df.withColumn("_k", place).where(F.col("_k") <= last).groupBy(key).agg(F.sqrt(F.avg(F.col(loss) * F.col(loss))).alias("w"))
    return rows.join(F.broadcast(rows.agg(F.sum("w").alias("_sum")))).select(key, (F.col("w") / F.col("_sum")).alias("weight"))
