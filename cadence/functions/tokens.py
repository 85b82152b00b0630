"""Event vocabulary: layout by prefix sums, encoding and decoding by joins with the (small, checked) vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A vocabulary has one row per event type; more than this is an error, so it may be broadcast.
MOST_TYPES = 10_000


def layout(ranges: DataFrame, offset: int = 0) -> DataFrame:
    """(type, lo, hi, tok_start, tok_end) from (seq, type, lo, hi): spans follow one another in order of seq."""
    if ranges.limit(MOST_TYPES + 1).count() > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types")
    width = F.col("hi") - F.col("lo") + 1
    end = F.sum(width).over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) + offset
    return ranges.select("type", "lo", "hi", (end - width).alias("tok_start"), end.alias("tok_end"))


def encode(events: DataFrame, vocabulary: DataFrame, type_col: str, value_col: str) -> DataFrame:
    """`events` with token; null for unknown types and values out of range (use strict() to fail on them)."""
    v = F.broadcast(vocabulary.select(F.col("type").alias("_type"), "lo", "hi", "tok_start"))
    inside = F.col(value_col).between(F.col("lo"), F.col("hi"))
    token = F.when(inside, F.col("tok_start") + F.col(value_col) - F.col("lo"))
    return events.join(v, F.col(type_col) == F.col("_type"), "left").withColumn("token", token).drop("_type", "lo", "hi", "tok_start")


def strict(encoded: DataFrame) -> DataFrame:
    """Fails when run on a row without a token."""
    return encoded.withColumn("token", F.when(F.col("token").isNull(), F.raise_error(F.lit("event out of range"))).otherwise(F.col("token")))


def decode(tokens: DataFrame, vocabulary: DataFrame, token_col: str) -> DataFrame:
    """`tokens` with type and value; null for tokens outside every span."""
    v = F.broadcast(vocabulary.select("type", "lo", "tok_start", "tok_end"))
    inside = (F.col(token_col) >= F.col("tok_start")) & (F.col(token_col) < F.col("tok_end"))
    return tokens.join(v, inside, "left").withColumn("value", F.col(token_col) - F.col("tok_start") + F.col("lo")).drop("lo", "tok_start", "tok_end")
