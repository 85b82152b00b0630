"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight; the mix holds `budget` times all words, shared by weight, and a source is repeated at most
`max_epochs` times (what it can't take is shared again by weight). Over the training time t in [0, 1] a source's rate
is target * (1 + slope * (2t - 1)): integrated, its cumulative demand is target * ((1 - slope) t + slope t^2), which
reaches the target at t = 1. Documents of a source stand in a hashed order; the copy that covers the words from c on
is trained at the t at which the cumulative demand is c, the inverse of that integral. Sorting all copies by position
over ranges gives the training order.

Prefix sums within a source go in two steps, hash buckets first and then rows of a bucket, so that a source with a
third of all rows is spread over all buckets. Sources are ranked over ranges, so there may be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.common import WORD
from cadence.operators.ranking import with_position
from cadence.session import written

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Hexadecimal digits of the hash that name a bucket: 4,096 buckets.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """From (source, size) rows: source, rank, weight, source_size, target.

    Budget is shared by weight; what is over a source's cap, `max_epochs` times its size, is shared again until none
    is over. Each round is one aggregate over the sources, of which there may be many.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    per = with_position(per, ["_last", "source"], "rank").drop("_last")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    per = written(per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    # a share of weight / open of the rest is over the cap once cap / weight is at most rest / open
    level, fixed = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") * F.lit(level[1]) <= F.col("weight") * F.lit(level[0])
        total, capped, free, n = per.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(over.cast("long")), F.lit(0)),
        ).first()
        if n == fixed or free == 0:
            break
        level, fixed = (total * budget - capped, free), n
    target = F.when(over, F.col("cap")) if level is None or free == 0 else F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(level[0]) / F.lit(level[1]))
    return per.select("source", "rank", "weight", "source_size", target.alias("target"))


def _demand(target: Column, slope: Column, t: Column) -> Column:
    """Words of a source wanted up to time t: the integral of target * (1 + slope * (2t - 1))."""
    return target * ((F.lit(1.0) - slope) * t + slope * t * t)


def _position(start: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] with target * ((1 - slope) t + slope t^2) = start."""
    share = F.least(start / target, F.lit(1.0))
    b = F.lit(1.0) - slope
    root = F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * share, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise(F.lit(2.0) * share / (b + root))


def curriculum(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
    weights=WEIGHTS,
    budget: float = 1.5,
    max_epochs: int = 2,
    slopes: tuple[float, ...] = (0.5, 0.0, -0.5),
    whole: bool = False,
    seed: int = 17,
) -> DataFrame:
    """Copies of documents at training positions, range-sorted by position.

    Returns one row per copy and at least one per document: id, size, source_size, target, taken (all words of the
    document that the mix takes), copy (0 first), words (of this copy), position (null if nothing is taken), last_position
    (of the document's last copy), then the columns in `keep`. `slopes` in [-1, 1] say how a source's rate changes over time, repeating as weights do.

    A source's last copy is cut to the words still wanted; with `whole` it is taken whole if at least half is wanted.
    No document is taken more than `max_epochs` times.

    Null texts and texts without words have size 0 and are never taken; a null source is a source of its own, the
    last; null and repeated ids are rows like others, and rows alike in all columns are ordered arbitrarily but are
    alike. The same table gives the same result whatever its partitions. An empty table gives an empty result.
    Further input columns are not read unless in `keep`, which must not hold the result's names.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    names = ("_id", "_source", *(f"_keep{i}" for i in range(len(keep))))
    rows = docs.select(
        *(F.col(c).alias(n) for c, n in zip((id_col, source_col, *keep), names, strict=True)), size.alias("_size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))).alias("_hash"),
    )
    # a key without nulls: joins and windows then agree on how rows are dealt out
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS)).withColumn("_key", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    sizes = written(rows.select("_id", "_source", "_key", "_size", "_hash", "_bucket"), "sizes")
    rows = rows if keep else sizes
    targets = source_targets(sizes.select(F.col("_source").alias("source"), F.col("_size").alias("size")), weights, budget, max_epochs)
    targets = targets.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    buckets = sizes.groupBy("_key", "_bucket").agg(F.sum("_size").alias("bucket_size"))
    base = F.sum("bucket_size").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = (
        buckets.withColumn("_base", F.coalesce(base, F.lit(0)))
        .join(targets, "_key")
        .select("_key", "_bucket", "_base", "rank", "source_size", "target")
    )
    rows = rows.join(buckets, ["_key", "_bucket"])
    within = Window.partitionBy("_key", "_bucket").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_base") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.col("rank") % len(slopes) + 1).cast("int"))
    wanted = F.least(F.round(_demand(F.col("target"), slope, F.lit(1.0))).cast("long"), F.col("source_size") * max_epochs)
    rows = rows.withColumn("_first", first).withColumn("_wanted", wanted).withColumn("_slope", slope)

    def part(copy: Column) -> Column:
        start = F.col("_first") + copy * F.col("source_size")
        left = F.greatest(F.least(F.col("_wanted") - start, F.col("_size")), F.lit(0))
        return F.when(left * 2 >= F.col("_size"), F.col("_size")).otherwise(F.lit(0)).cast("long") if whole else left.cast("long")

    copies = F.transform(
        F.sequence(F.lit(0), F.lit(max_epochs - 1)),
        lambda c: F.struct(
            c.alias("copy"),
            part(c).alias("words"),
            F.when(part(c) > 0, _position((F.col("_first") + c * F.col("source_size")).cast("double"), F.col("target"), F.col("_slope"))).alias("position"),
        ),
    )
    rows = rows.withColumn("_copies", copies).withColumn("_taken", F.aggregate("_copies", F.lit(0).cast("long"), lambda a, c: a + c.words))
    rows = rows.withColumn("_c", F.explode(F.filter("_copies", lambda c: (c.copy == 0) | (c.words > 0))))
    out = rows.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"),
        F.col("_c.copy").alias("copy"), F.col("_c.words").alias("words"), F.col("_c.position").alias("position"),
        F.array_max("_copies.position").alias("last_position"),
        *(F.col(n).alias(c) for c, n in zip(keep, names[2:], strict=True)),
    )
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col(id_col)).sortWithinPartitions(
        F.col("position").asc_nulls_last(), F.col(id_col), "copy"
    )
