"""Line dedup: lines that many documents share stay in one of them only.

A line's key is the line without white space at both ends and with A-Z in lower case; it is carried as two 64-bit
hashes. Keys are range-partitioned by hash with a secondary sort by document (the largest id first) and position, and
one pass over each range streams them: the document that comes first keeps its lines, later ones lose theirs if there
are enough documents. What comes out is a run-length bitmap of kept lines for each document that loses any, never text.

A key that alone would fill much of a task (a sketch of frequent hashes finds them, of bounded size) takes another way
to the same result: its documents are counted by partial sums, and its count and largest id, one row a key, are
broadcast. The sketch decides where the work is done, never what comes out. All is done by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.common import WORD_GAPS, partitions
from cadence.session import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Slices of the hashes with a sketch each, hashes that a sketch tracks and those it gives back: at most SLICES * TOP keys are broadcast.
SLICES, TRACKED, TOP = 64, 2048, 500
#: A key is frequent from this many lines on, and from this part of what a task holds on average.
FREQUENT_LINES, FREQUENT_PART = 1000, 4


def key_of(line: Column) -> Column:
    """The line with ASCII white space stripped at both ends and A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WORD_GAPS)), _UPPER, _UPPER.lower())


def _text(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc_id, text_key, n_lines, pos): the hashed keys of at least `min_chars` code points, pos from 0."""
    lines = _text(docs).select("doc_id", "text_key", F.split("text", "\n").alias("lines"))
    rows = lines.select("doc_id", "text_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("line", key_of(F.col("line"))).where(F.length("line") >= min_chars)
    return rows.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "text_key", "n_lines", "pos")


def frequent(rows: DataFrame, least: int = FREQUENT_LINES) -> DataFrame:
    """(h1): hashes of keys that would fill much of one task; at most SLICES * TOP."""
    top = F.expr(f"approx_top_k(h1, {TOP}, {TRACKED})")
    slices = written(rows.groupBy(F.pmod("h1", F.lit(SLICES)).alias("slice")).agg(F.count("*").alias("n"), top.alias("top")), "frequent")
    total = slices.agg(F.sum("n")).first()[0] or 0
    bound = max(least, total // (FREQUENT_PART * partitions(rows.sparkSession)))
    return slices.select(F.inline("top")).where(F.col("count") >= bound).select(F.col("item").alias("h1"))


def _of_ranges(rows: DataFrame, min_docs: int) -> DataFrame:
    """The rows that lose their line, by a pass over ranges of hashes sorted by document and position."""
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "h1", "h2")
    of_key = Window.partitionBy("h1", "h2")
    in_order = of_key.orderBy(F.desc("doc_id"), "text_key", "pos")
    new = (F.row_number().over(in_order) == 1) | ~F.lag("doc_id").over(in_order).eqNullSafe(F.col("doc_id"))
    ranked = ranged.withColumn("new", new.cast("int")).withColumn("rank", F.sum("new").over(in_order))
    return ranked.withColumn("n_docs", F.sum("new").over(of_key)).where((F.col("rank") > 1) & (F.col("n_docs") >= min_docs))


def _of_frequent(rows: DataFrame, min_docs: int) -> DataFrame:
    """The same for few keys of very many rows: partial sums for each key, broadcast to its rows."""
    totals = rows.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    return rows.join(F.broadcast(totals.where(F.col("n_docs") >= min_docs)), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))


def bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, frequent_lines: int = FREQUENT_LINES) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) for each document that loses lines.

    A key of at least `min_chars` code points in at least `min_docs` documents stays only in the largest doc_id that has
    it, with all its lines there. `keep` is the bitmap of kept lines as runs of ones: (start, length), in order.

    Rows that share a doc_id are one document when documents are counted and when the last one is found, and each has
    its own bitmap, found by text_key (a hash of its text); a null doc_id counts as one document, before all others.
    Null and empty texts are one empty line. An empty table gives an empty result.
    """
    rows = written(keys(docs, min_chars), "line-keys")
    hot = written(frequent(rows, frequent_lines), "frequent-keys")
    ranges = _of_ranges(rows.join(F.broadcast(hot), "h1", "left_anti"), min_docs)
    common = _of_frequent(rows.join(F.broadcast(hot), "h1", "left_semi"), min_docs)
    fields = ("doc_id", "text_key", "n_lines", "pos")
    lost = ranges.select(*fields).unionByName(common.select(*fields))
    lost = lost.groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("lost"))
    starts = F.concat(F.array(F.lit(0)), F.transform("lost", lambda p: p + 1))
    ends = F.concat("lost", F.array("n_lines"))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length")))
    keep = F.filter(runs, lambda r: r["length"] > 0)
    return lost.select("doc_id", "text_key", "n_lines", F.size("lost").alias("n_dropped"), keep.alias("keep"))


def apply(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each document with the lines that its bitmap keeps, joined by line feeds.

    `maps` comes from bitmaps() of the same documents; Spark broadcasts it where its files are small and shuffles
    otherwise. Documents without a bitmap keep all. Null texts become empty.
    """
    maps = maps.select(F.col("doc_id").alias("map_id"), F.col("text_key").alias("map_key"), "n_dropped", "keep")
    same = F.col("doc_id").eqNullSafe(F.col("map_id")) & (F.col("text_key") == F.col("map_key"))
    lines = F.split("text", "\n")
    kept = F.flatten(F.transform("keep", lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return _text(docs).join(maps, same, "left").select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
