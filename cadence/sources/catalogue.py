"""Readers of catalogues and side tables. Schemas are given, never inferred; columns not asked for are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field names and types of the files that are read.
CHARTS = """BeatmapSetId long, Id long, BeatmapIdx int, BeatmapSetFolder string, AudioFile string, BeatmapFile string, ModeInt int,
RankedDate timestamp_ntz, SubmittedDate timestamp_ntz, DifficultyRating double, StarRating array<double>, UserId long, OmdbTags array<string>"""
TRACK = """BeatmapSetId long, Artist string, Title string, Creator string, Source string, Tags string,
Beatmaps map<string, struct<BeatmapId: long, Index: int, Difficulty: string, DrainTime: double, TotalTime: double, CirclesCount: int, SlidersCount: int,
SpinnersCount: int, CircleSize: double, ApproachRate: double, OverallDifficulty: double, HPDrain: double, StandardStarRating: map<string, double>>>"""
MAPPERS = "id long, user_id long, username array<string>"
DESCRIPTORS = "beatmap_id long, descriptor string"
WEIGHTS = "beatmap_id long, weight double"


def charts(spark: SparkSession, path: str) -> DataFrame:
    """The chart catalogue; BeatmapIdx, a chart's place before sorting, is a stored column since rows have no order."""
    return spark.read.schema(CHARTS).parquet(path)


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, with the file it came from."""
    return spark.read.schema(TRACK).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def flat_charts(tracks_: DataFrame) -> DataFrame:
    """One row per chart of each track: the map of charts exploded, star ratings at normal and raised speed taken out."""
    rows = tracks_.select("BeatmapSetId", "Artist", "Title", "Creator", "Source", "Tags", F.explode("Beatmaps").alias("Version", "c"))
    stars = F.col("c.StandardStarRating")
    return rows.select("*", "c.*", stars["0"].alias("Stars"), stars["64"].alias("StarsFast")).drop("c", "StandardStarRating")


def mappers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPERS).option("multiLine", True).json(path)


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DESCRIPTORS).csv(path)


def weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHTS).csv(path)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """One whole number per line; blank and other lines are left out."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS long)").alias("id")).where("id IS NOT NULL")


def numbered_files(spark: SparkSession, pattern: str, start: int, end: int) -> DataFrame:
    """Files below folders Track00000, Track00001, ... with numbers in [start, end): (path, track). Contents are not read."""
    rows = spark.read.format("binaryFile").load(pattern).select("path")
    track = F.regexp_extract("path", r"Track(\d{5})", 1).cast("int")
    return rows.withColumn("track", track).where((F.col("track") >= start) & (F.col("track") < end))


def metric_log(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, line, metric, value): lines `name: number` of log files, in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return metric_lines(lines, names)


def metric_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    """metric_log() of lines (file, line, text) that were read in another way."""
    pattern = "^\\s*(" + "|".join(names) + r"):\s*(-?\d+(?:\.\d+)?)"
    found = lines.where(F.col("text").rlike(pattern))
    return found.select("file", "line", F.regexp_extract("text", pattern, 1).alias("metric"), F.regexp_extract("text", pattern, 2).cast("double").alias("value"))


def after_marker(lines: DataFrame, text: str, marker: str, width: int) -> DataFrame:
    """The number in the `width` characters after a marker, of lines that have it."""
    at = F.instr(F.col(text), marker)
    return lines.where(at > 0).withColumn("value", F.substring(F.col(text), at + len(marker), F.lit(width)).cast("double"))


def header_field(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(file, value) of the first `field: value` line of each file."""
    pattern = rf"(?m)^{field}:\s*(.*?)\s*$"
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("file"), F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).alias("found")).withColumnRenamed("found", "value")
