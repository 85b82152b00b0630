"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replace_parquet(df: DataFrame, path: str) -> None:
    """Write `df` over a plain folder that it may itself read: a sibling folder first, then a swap of names.

    Between the two renames nothing has the table's name; commit() has no such moment, but its readers need committed().
    """
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(new)
    jvm = spark.sparkContext._jvm
    to = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to(old), True)
    if fs.exists(to(path)):
        fs.rename(to(path), to(old))
    fs.rename(to(new), to(path))
    fs.delete(to(old), True)


#: The file in a table's folder that names its current version.
POINTER = "_current"


def commit(df: DataFrame, path: str, keep: int = 1) -> str:
    """Write `df` as the new version of the table at `path`, which `df` may itself read, and return the version's name.

    A version is a folder of its own, and a pointer file names the current one. The pointer is written beside and renamed
    over the old one in one step once the version is whole, so whoever reads finds the old version or the new one, and a
    writer that dies before leaves the old version in place. Of the versions before, the newest `keep` stay for readers
    that began with them; older ones and what a lost writer left go.

    One writer at a time: of two at once the last to rename its pointer wins. The rename replaces a file in one step on
    HDFS and local disks; on an object store it is a copy of one small file. An empty `df` is a version without rows.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *parts)))
    fs = to().getFileSystem(conf)
    before = sorted((s.getModificationTime(), s.getPath().getName()) for s in _versions(spark, path))
    current = _current(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{version}")

    beside = to(f"{POINTER}-{version}")
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, to(POINTER), options)

    # the version that was current is the newest of those to keep, whatever lost writers have left after it
    older = [name for _, name in before if name != current]
    older = [*older, current] if current else older
    for name in older[: max(0, len(older) - keep)]:
        fs.delete(to(name), True)
    return version


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at `path`; an error where none has been committed."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version has been committed at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def _current(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream)).readLine()
    finally:
        stream.close()


def _versions(spark: SparkSession, path: str) -> list:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("v-")] if fs.exists(folder) else []


def scores_csv(df: DataFrame, path: str, id_col: str, score_col: str) -> None:
    df.select(id_col, score_col).write.mode("overwrite").csv(path)


def vocabulary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def chart_text(header: DataFrame, points: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """(key, value): whole chart files as text, from header text and lines of timing points and hit objects by seq.

    `header` has (key, header); the others (key, seq, text). Each chart is one row; write it with DataFrame.write.text
    partitioned by the key.
    """
    listed = lambda df: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    p = points.groupBy(key).agg(listed(points).alias("points"))
    o = objects.groupBy(key).agg(listed(objects).alias("objects"))
    body = F.concat_ws("\n", "header", F.lit("[TimingPoints]"), F.coalesce("points", F.lit("")), F.lit("\n[HitObjects]"), F.coalesce("objects", F.lit("")))
    return header.join(p, key, "left").join(o, key, "left").select(key, body.alias("value"))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """`df` with later rows of a name renamed to `stem (n).extension`, n from 1, in `order`."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))).drop("_n")


def html_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value): one HTML table row per row, text escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    return df.select(F.concat(F.lit("<tr>"), *map(cell, columns), F.lit("</tr>")).alias("value"))


def metrics(df: DataFrame, path: str, bins: str) -> None:
    df.write.mode("overwrite").partitionBy(bins).parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
