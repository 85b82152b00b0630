"""Chart text files: sections in brackets, `key:value` lines, timing points and hit objects as comma-separated lines.

Files are split into lines that know their section; everything after that is columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits of a hit object's type.
CIRCLE, SLIDER, NEW_COMBO, SPINNER, HOLD = 1, 2, 4, 8, 128


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, section, text) of non-empty lines that are not comments; lines before any section have none."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    head = F.nullif(F.regexp_extract("text", r"^\[(\w+)\]\s*$", 1), F.lit(""))
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(order))
    return rows.where("head IS NULL AND trim(text) <> '' AND NOT startswith(text, '//')").select("file", "line", "section", "text")


def settings(rows: DataFrame) -> DataFrame:
    """(file, section, key, value) of `key:value` lines."""
    pair = F.split("text", ":", 2)
    kept = rows.where(F.col("section").isin("General", "Editor", "Metadata", "Difficulty") & F.contains("text", F.lit(":")))
    return kept.select("file", "section", F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def timing_points(rows: DataFrame) -> DataFrame:
    """(file, seq, offset_ms, value, meter, sample_type, sample_set, volume, is_red, kiai).

    Missing trailing fields take the format's defaults; offsets are cut to whole milliseconds.
    """
    f = lambda i, d: F.coalesce(F.expr(f"try_cast(get(split(text, ','), {i}) AS double)"), F.lit(float(d)))
    points = rows.where("section = 'TimingPoints'")
    return points.select(
        "file", F.col("line").alias("seq"), f(0, 0).cast("long").alias("offset_ms"), f(1, 1000).alias("value"), f(2, 4).cast("int").alias("meter"),
        f(3, 1).cast("int").alias("sample_type"), f(4, 0).cast("int").alias("sample_set"), f(5, 100).cast("int").alias("volume"),
        (f(6, 1) == 1).alias("is_red"), (f(7, 0).cast("int").bitwiseAND(1) == 1).alias("kiai"),
    )


def hit_objects(rows: DataFrame) -> DataFrame:
    """(file, seq, x, y, time_ms, kind, new_combo, hitsound, params): params are the fields after the fifth."""
    parts = F.split("text", ",")
    kind_bits = F.get(parts, F.lit(3)).cast("int")
    kind = (
        F.when(kind_bits.bitwiseAND(CIRCLE) > 0, "circle").when(kind_bits.bitwiseAND(SLIDER) > 0, "slider")
        .when(kind_bits.bitwiseAND(SPINNER) > 0, "spinner").when(kind_bits.bitwiseAND(HOLD) > 0, "hold")
    )
    number = lambda i: F.get(parts, F.lit(i)).cast("double")
    objects = rows.where("section = 'HitObjects'")
    return objects.select(
        "file", F.col("line").alias("seq"), number(0).alias("x"), number(1).alias("y"), number(2).cast("long").alias("time_ms"), kind.alias("kind"),
        (kind_bits.bitwiseAND(NEW_COMBO) > 0).alias("new_combo"), number(4).cast("int").alias("hitsound"), F.slice(parts, 6, F.greatest(F.size(parts), F.lit(1))).alias("params"),
    )
