"""URL filters: a sort-merge range join of urls against nested host rules.

A host becomes a canonical key with its labels reversed (`a.example.net` -> `net.example.a.`), so a rule for a host
and its subdomains is one interval of keys: from `net.example.` up to, not including, `net.example/`. Intervals of
rules are nested or disjoint. Sorting urls and interval ends together and sweeping over them keeps, at each point, the
stack of active rules; the last interval end before a url holds that stack. Among the rules on the stack whose path
starts the url's path, the longest wins.

The sorted order is cut into blocks at sampled (key, url hash) points, so that one frequent host fills many blocks.
Each block starts with the stack that is active at its cut, so blocks are swept on their own. There are a few blocks
for each shuffle partition, which a session sets by the size of its data; a url's block is found by binary search.
Everything is DataFrame work; the cuts are all that the driver sees, and they have no influence on results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadence.llm.common import partitions

#: Blocks for each shuffle partition, most cuts, and sampled points for each cut (more of them make blocks more alike).
BLOCKS, MOST_CUTS, POINTS = 4, 16_384, 8
RULE_SCHEMA = "host string, path string, verdict string"
_RULE = "struct<size:int,host:string,path:string,rule:string,verdict:string>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels reversed, each with a dot after it; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _stacks(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, stack): for each key of `nodes`, the rules whose host key starts it, found by joining its label prefixes."""
    labels = F.split(F.expr("rtrim('.', key)"), r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )
    return (
        nodes.select("key", F.explode(prefixes).alias("prefix"))
        .join(rules, F.col("prefix") == F.col("rule_key"), "left")
        .groupBy("key")
        .agg(F.collect_set("entry").alias("stack"))
    )


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    cuts: int | None = None,
) -> DataFrame:
    """Judge every row of `pages` by `rules` (host, path, verdict).

    Returns `id_col`, host, path, rule (host followed by path; null if none fits), verdict. A rule fits its host and
    all subdomains if the url's path starts with the rule's path. The longest rule wins; of equally long ones that
    with the longer host, then the greater text. Without a rule the verdict is `default`.

    Null urls and urls without `://` have empty host and path and fit no rule. Repeated rows stay repeated. Only the
    two columns are read, so further columns cannot clash. Empty tables of pages or rules are fine; rules with a null
    or empty host are ignored and a null path means every path. `cuts`, if given, is the number of cuts between blocks.
    Texts of any length are read whole; ids keep their type.
    """
    spark = pages.sparkSession
    cuts = cuts or min(MOST_CUTS, BLOCKS * partitions(spark))
    entry = F.struct(
        (F.length("host") + F.length("path")).cast("int").alias("size"), "host", "path", F.concat("host", "path").alias("rule"), "verdict"
    ).cast(_RULE)
    rules = (
        rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where(F.coalesce("host", F.lit("")) != "")
        .select(host_key(F.col("host")).alias("rule_key"), entry.alias("entry"))
    )
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).select(
        "*", host_key(F.col("host")).alias("key"), F.xxhash64("id", "host", "path").alias("tie")
    )
    # a uniform sample, the rows with the smallest hashes; every POINTS-th of them in order is a cut
    picked = urls.select("key", "tie").orderBy(F.xxhash64("tie")).limit(cuts * POINTS).collect()
    points = sorted({(r.key, r.tie) for r in picked})[POINTS - 1 :: POINTS]
    cut_type = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("tie", T.LongType())]))
    block = _place(F.from_json(F.lit(_json(points)), cut_type), len(points))

    nodes = rules.select(F.col("rule_key").alias("key")).distinct()
    parents = nodes.select(F.expr("regexp_replace(key, '[^.]*[.]$', '')").alias("key"), F.col("key").alias("node"))
    lowest = F.lit(-(2**63)).cast("long")
    empty = F.array().cast(f"array<{_RULE}>")
    opens = _stacks(nodes, rules).select("key", F.lit(1).alias("kind"), lowest.alias("tie"), "stack")
    closes = (
        parents.join(_stacks(parents.select("key").distinct(), rules), "key", "left")
        .select(
            F.expr("concat(substr(node, 1, length(node) - 1), '/')").alias("key"), F.lit(0).alias("kind"), lowest.alias("tie"),
            F.coalesce("stack", empty).alias("stack"),
        )
    )
    cut_rows = spark.createDataFrame([(k, t) for k, t in points], "key string, tie long")
    # at most MOST_CUTS keys, so their stacks may be broadcast; many cuts may lie in one host
    starts = (
        cut_rows.join(F.broadcast(_stacks(cut_rows.select("key").distinct(), rules)), "key", "left")
        .select("key", F.lit(2).alias("kind"), "tie", F.coalesce("stack", empty).alias("stack"))
    )
    none = F.lit(None)
    swept = (
        opens.unionByName(closes)
        .unionByName(starts)
        .select("*", none.cast(urls.schema["id"].dataType).alias("id"), none.cast("string").alias("host"), none.cast("string").alias("path"))
        .unionByName(
            urls.select("key", F.lit(3).alias("kind"), "tie", none.cast(f"array<{_RULE}>").alias("stack"), "id", "host", "path")
        )
        .withColumn("block", block)
    )
    order = Window.partitionBy("block").orderBy("key", "tie", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.filter(F.coalesce("active", empty), lambda r: F.startswith(F.col("path"), r["path"]) & (F.col("host") != ""))
    best = F.array_max(fits)
    return (
        swept.withColumn("active", F.last("stack", ignorenulls=True).over(order))
        .where("kind = 3")
        .withColumn("best", best)
        .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def _place(cuts: Column, n: int) -> Column:
    """How many of the `n` sorted cuts are at or before a row's (key, tie): a binary search, a step for each power of two."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    if not steps:
        return F.lit(0)

    def step(lo: Column, width: Column) -> Column:
        cut = F.get(cuts, lo + width - 1)
        reached = (cut.key < F.col("key")) | ((cut.key == F.col("key")) & (cut.tie <= F.col("tie")))
        return lo + F.when(reached, width).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _json(points) -> str:
    import json

    return json.dumps([{"key": k, "tie": t} for k, t in points])
