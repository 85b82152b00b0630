"""A Merkle manifest of a dataset: a tree over each source's documents, and one over the sources.

Documents become leaves where they are read, so only digests are shuffled. Leaves are numbered in order by range
partitions and prefix sums. Trees grow level by level with a slot pivot: conditional aggregates spread the children of
a parent into one column for each slot; the columns put together give the parent's digest, and without a child's own
column they are its siblings.

LEVELS levels are grown between two shuffles: rows are dealt out by (tree, block of FANOUT ** LEVELS leaves), and the
groups of each of these levels lie inside a block, so a source with very many documents is spread over very many tasks.
A block's pivots are kept as nested columns; going down again they are unfolded in place, so a path of siblings is
never shuffled for a leaf, only for the roots of blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import partitions
from cadence.operators.ranking import with_position
from cadence.session import written

#: Children of a node; levels between two shuffles (a block has FANOUT ** LEVELS leaves, 27).
FANOUT, LEVELS = 3, 3
#: Sources up to which their table (a row a source) is broadcast to the leaves.
MOST_BROADCAST = 1_000_000
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row of documents with `text` for its text."""
    return digest(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text))


def height(n: Column) -> Column:
    """Levels above n leaves until one node is left."""
    return reduce(lambda a, b: a + b, ((F.lit(FANOUT**k) < n).cast("int") for k in range(40)))


def _grow(leaves: DataFrame, done: int) -> DataFrame:
    """LEVELS levels above (tree, height, idx, node) with node.h; the new nodes hold their children c0, c1, ... .

    Levels above a tree's height keep its digest. `done` levels are below the leaves.
    """
    spark = leaves.sparkSession
    block = F.floor(F.col("idx") / F.lit(FANOUT**LEVELS)).alias("block")
    rows = leaves.select("tree", "height", block, "idx", "node").repartition(partitions(spark), "tree", "block")
    for level in range(done + 1, done + LEVELS + 1):
        slots = [F.first(F.when(F.col("idx") % FANOUT == k, F.col("node")), ignorenulls=True).alias(f"c{k}") for k in range(FANOUT)]
        rows = rows.groupBy("tree", "height", "block", F.expr(f"idx div {FANOUT}").alias("idx")).agg(*slots)
        together = digest(*(F.coalesce(F.col(f"c{k}.h"), F.lit("")) for k in range(FANOUT)))
        h = F.when(F.col("height") >= level, together).otherwise(F.col("c0.h"))
        node = F.struct(h.alias("h"), *(f"c{k}" for k in range(FANOUT)))
        rows = rows.select("tree", "height", "block", "idx", node.alias("node"))
    return rows.drop("block")


def _unfold(rows: DataFrame, done: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(tree, height, *carry, idx, node, path) of the leaves below (tree, height, idx, node, path); the inverse of _grow()."""
    for level in range(done + LEVELS, done, -1):
        hashes = [F.coalesce(F.col(f"node.c{k}.h"), F.lit("")) for k in range(FANOUT)]
        children = []
        for k in range(FANOUT):
            left, right = F.concat(F.lit(""), *hashes[:k]), F.concat(F.lit(""), *hashes[k + 1 :])
            here = F.array_prepend(F.col("path"), F.struct(left.alias("left"), right.alias("right")))
            path = F.when(F.col("height") >= level, here).otherwise(F.col("path")).cast(_PATH)
            children.append(F.struct((F.col("idx") * FANOUT + k).alias("idx"), F.col(f"node.c{k}").alias("node"), path.alias("path")))
        rows = rows.select("tree", "height", *carry, F.inline(F.filter(F.array(*children), lambda c: c["node"].isNotNull())))
    return rows


def grow(leaves: DataFrame, highest: int) -> list[DataFrame]:
    """Written rounds of LEVELS levels each above (tree, height, idx, node), until each tree has one row: its root."""
    rounds = []
    while not rounds or len(rounds) * LEVELS < highest:
        rows = leaves if not rounds else rounds[-1].select("tree", "height", "idx", F.struct(F.col("node.h").alias("h")).alias("node"))
        rounds.append(written(_grow(rows, LEVELS * len(rounds)), "merkle-round"))
    return rounds


def paths(rounds: list[DataFrame], above: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(tree, height, *carry, idx, node, path): each leaf with the siblings on its way up.

    The path goes on with that of `above` (tree, path, *carry), a row a tree.
    """
    rows = rounds[-1].withColumn("path", F.array().cast(_PATH)) if above is None else rounds[-1].join(above, "tree")
    for k in range(len(rounds) - 1, 0, -1):
        rows = rounds[k - 1].join(_unfold(rows, LEVELS * k, carry).drop("height", "node"), ["tree", "idx"])
    return _unfold(rows, 0, carry)


def leaves_of(docs: DataFrame, tampered: Column, text: Column) -> DataFrame:
    """(doc_id, source, leaf, changed): a document's leaf, and its leaf with `text` for its text where `tampered`, else null."""
    changed = F.when(tampered, leaf(text))
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), changed.alias("changed"))


def manifest(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (doc_id, source, leaf, changed).

    A source's leaves are in order of doc_id, null first; rows that share an id are in order of their leaves, so
    repeated rows are leaves of their own. Sources are in order of their bytes, null first. `proof_sha256` is the digest
    of all siblings on the way to the root, `folded_root` the root worked out from `changed` (else leaf) and them. A
    single document has no siblings: its proof is the digest of nothing and its leaf is the root. No rows, no result.
    """
    ordered = written(with_position(leaves, ["source", "doc_id", "leaf"]), "leaves")
    sources = ordered.groupBy("source").agg(F.count("*").alias("n"), F.min("position").alias("base"))
    sources = written(with_position(sources, ["source"], "tree").withColumn("height", height(F.col("n"))), "sources")
    n_sources, highest = sources.agg(F.count("*"), F.coalesce(F.max("height"), F.lit(0))).first()
    if not n_sources:
        return leaves.limit(0).selectExpr("doc_id", "leaf", "leaf subroot", "leaf root", "leaf proof_sha256", "leaf folded_root", "true verified")
    of_source = sources.select(F.col("source").alias("_source"), "tree", "height", "base")
    if n_sources <= MOST_BROADCAST:
        of_source = F.broadcast(of_source)
    numbered = ordered.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", "height", (F.col("position") - F.col("base")).alias("idx"), F.struct(F.col("leaf").alias("h"), "changed", "doc_id").alias("node")
    )
    rounds = grow(numbered, highest)

    subroots = rounds[-1].select("tree", F.col("node.h").alias("subroot"))
    top_height = height(F.lit(n_sources))
    as_leaf = F.struct(F.col("subroot").alias("h"), F.col("tree").alias("of"))
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), top_height.alias("height"), F.col("tree").alias("idx"), as_leaf.alias("node"))
    top_rounds = grow(tops, next(k for k in range(40) if FANOUT**k >= n_sources))
    root = F.lit(top_rounds[-1].select("node.h").first()[0])
    above = paths(top_rounds).select(F.col("node.of").alias("tree"), F.col("node.h").alias("subroot"), "path")

    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("node.changed", "node.h"), lambda h, s: digest(s["left"], h, s["right"]))
    found = paths(rounds, above, ("subroot",)).select("node.doc_id", F.col("node.h").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
