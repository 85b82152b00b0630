"""The prefix trie of conversations, by collapsing whole sequences.

Turns are carried as digests, so no text is shuffled. A sequence's key, and that of each prefix, is the exclusive or of
hashes of (depth, turn) in two 64-bit words: it is put together from parts in any order, so no task has to hold a long
conversation. Identical conversations become one weighted sequence with the list of those that end there; sequences
that are no proper prefix of another (an anti-join) are the leaves; weighted prefixes of the sequences are the nodes.

A subtree is summed along sequences: each node counts for the sequence of its smallest member, sums run from the end of
a sequence to its start, and at each node the sums of all sequences through it are added up.

Sequences are cut into blocks of BLOCK turns, with sums carried from block to block; what many rows share (the root, a
common first turn, a parent of many, copies of one conversation) meets partial sums or a broadcast of a few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.common import partitions
from cadence.operators.ranking import with_position
from cadence.session import written

#: Turns of a block; numbers of a chunk of an end list; a parent of this part of all nodes has its children by broadcast.
BLOCK, CHUNK, MANY = 1024, 256, 1000
#: Conversations that share a base, and what the number of turns taken from it is a remainder of.
HUNDRED, HEADS = 100, 6
KEY = ["ka", "kb", "depth"]


def print_of(role: Column, text: Column) -> Column:
    """md5 of a turn: the role's number of bytes, `:`, role and text."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def _blocks(few: DataFrame, last: str) -> DataFrame:
    """`few` with a row for each block, from 0 to that of place `last` (from 0)."""
    return few.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"({last}) div {BLOCK}"), F.lit(0)))))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len), and the turns (conv_id, depth, block, print, chars), of the rebuilt conversations.

    Conversation c begins with the first h turns of c - c % HUNDRED, h being crc32 of its number modulo HEADS, and goes
    on with its own turns after its first h. Turns are in order of turn, null first; rows of one turn are in order of
    print_of(). Null roles and texts count as empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", print_of(role, text).alias("print"), F.length(text).cast("long").alias("chars")
    )
    placed = with_position(rows, ["conv_id", "turn", "print"]).drop("turn")

    convs = placed.groupBy("conv_id").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")

    # a conversation's rows meet its numbers by blocks of their positions, so a long one is spread
    spread = convs.withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"(first + n - 1) div {BLOCK}"))))
    turns = placed.withColumn("block", F.expr(f"position div {BLOCK}")).join(spread, ["conv_id", "block"])
    turns = turns.withColumn("pos", F.col("position") - F.col("first") + 1)
    own = turns.where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "print", "chars")
    heads = turns.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < HEADS)).select("base", F.col("pos").alias("depth"), "print", "chars")
    # at most HEADS - 1 turns for each conversation
    shared = convs.join(heads, "base").where("depth <= taken").select("conv_id", "depth", "print", "chars")
    both = own.unionByName(shared).withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    return convs.select("conv_id", "len"), written(both, "rebuilt")


def sequences_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ka, kb, depth, conv_id) of each conversation, and (conv_id, block, before_a, before_b): keys of all blocks before."""
    hashes = turns.select("conv_id", "block", F.xxhash64("depth", "print").alias("a"), F.xxhash64(F.lit(1), "print", "depth").alias("b"))
    blocks = written(hashes.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")), "blocks")
    whole = blocks.groupBy("conv_id").agg(F.bit_xor("a").alias("ka"), F.bit_xor("b").alias("kb"))
    zero = F.lit(0).cast("long")
    ends = convs.join(whole, "conv_id", "left").select(F.coalesce("ka", zero).alias("ka"), F.coalesce("kb", zero).alias("kb"), F.col("len").alias("depth"), "conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.bit_xor(c).over(earlier), zero).alias(f"before_{c}") for c in "ab"]
    return written(ends, "ends"), blocks.select("conv_id", "block", *before)


def end_digests(ends: DataFrame) -> DataFrame:
    """(ka, kb, depth, ends_sha256): the numbers of a sequence's conversations, ascending, with commas between.

    Numbers are joined in chunks of at most CHUNK, which are then streamed through the digest in order, so no list of
    all is ever held.
    """
    chunks = with_position(ends, [*KEY, "conv_id"]).withColumn("chunk", F.expr(f"position div {CHUNK}"))
    chunks = chunks.groupBy(*KEY, "chunk").agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    dealt = chunks.repartition(partitions(ends.sparkSession), *KEY).sortWithinPartitions(*KEY, "chunk")
    return dealt.mapInPandas(_stream, "ka long, kb long, depth long, ends_sha256 string")


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, sha = None, None
    for batch in batches:
        done = []
        for ka, kb, depth, ids in zip(batch["ka"], batch["kb"], batch["depth"], batch["ids"]):
            if (ka, kb, depth) == at:
                sha.update(b",")
            else:
                if at:
                    done.append((*at, sha.hexdigest()))
                at, sha = (ka, kb, depth), hashlib.sha256()
            sha.update(ids.encode())
        yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
    if at:
        yield pd.DataFrame([(*at, sha.hexdigest())], columns=[*KEY, "ends_sha256"])


def _prefixes(sequences: DataFrame, turns: DataFrame, before: DataFrame) -> DataFrame:
    """(conv_id, block, depth, len, weight, ka, kb, pa, pb, chars): each prefix of each sequence, its key and its parent's."""
    of_block = _blocks(sequences.select("conv_id", "weight", F.col("depth").alias("len")), "len - 1").join(before, ["conv_id", "block"])
    rows = turns.join(of_block, ["conv_id", "block"])
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", F.xxhash64("depth", "print")).withColumn("b", F.xxhash64(F.lit(1), "print", "depth"))
    for c in "ab":
        rows = rows.withColumn(f"k{c}", F.bit_xor(c).over(so_far).bitwiseXOR(F.col(f"before_{c}")))
    rows = rows.select(
        "conv_id", "block", "depth", "len", "weight", "ka", "kb", F.col("ka").bitwiseXOR(F.col("a")).alias("pa"), F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "chars"
    )
    zero, none = (F.lit(x).cast("long") for x in (0, None))
    roots = sequences.select(
        "conv_id", zero.alias("block"), zero.alias("depth"), F.col("depth").alias("len"), "weight", zero.alias("ka"), zero.alias("kb"),
        none.alias("pa"), none.alias("pb"), zero.alias("chars"),
    )
    return rows.unionByName(roots)


def _saved(prefixes: DataFrame, nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """(ka, kb, depth, saved_tokens): each node's (n_convs - 1) * chars, summed over its subtree."""
    own = nodes.select(
        "conv_id", "depth", F.expr(f"greatest((depth - 1) div {BLOCK}, 0)").alias("block"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own")
    ).where("own <> 0")
    of_block = own.groupBy("conv_id", "block").agg(F.sum("own").alias("total"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    of_block = _blocks(sequences.select("conv_id", "depth"), "depth - 1").drop("depth").join(of_block, ["conv_id", "block"], "left")
    of_block = of_block.select("conv_id", "block", F.coalesce(F.sum("total").over(after), F.lit(0)).alias("later"))
    rows = prefixes.select("conv_id", "block", *KEY).join(own.drop("block"), ["conv_id", "depth"], "left").join(of_block, ["conv_id", "block"])
    to_end = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    below = F.coalesce(F.sum("own").over(to_end), F.lit(0)) + F.col("later")
    return rows.select(*KEY, below.alias("below")).groupBy(*KEY).agg(F.sum("below").alias("saved_tokens"))


def _with_parents(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """`nodes` with parent_conv_id. Parents of very many children (less than MANY of them) are broadcast, others joined by shuffle."""
    parent = [F.col("pa") == F.col("qa"), F.col("pb") == F.col("qb"), F.col("depth") == F.col("child_depth")]
    names = nodes.select(F.col("ka").alias("qa"), F.col("kb").alias("qb"), (F.col("depth") + 1).alias("child_depth"), F.col("conv_id").alias("parent_conv_id"), *KEY)
    many = children.where(F.col("n_children") > nodes.count() // MANY).select(*KEY)
    many = written(names.join(F.broadcast(many), KEY).drop(*KEY), "many-children")
    names = names.drop(*KEY)
    common = nodes.join(F.broadcast(many), parent)
    others = nodes.where("depth > 0").join(F.broadcast(many.drop("parent_conv_id")), parent, "left_anti").join(names, parent)
    roots = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    drop = ("qa", "qb", "child_depth")
    return common.drop(*drop).unionByName(others.drop(*drop)).unionByName(roots)


def trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first turns (role, text) of rebuilt conversations (see rebuilt(), which states
    what becomes of nulls, ties and repeated rows); conv_id is the smallest of those that begin with it. The root has
    no parent and depth 0; it is there if any conversation is, so an empty table gives no rows.
    """
    convs, turns = rebuilt(conversations)
    ends, before = sequences_of(convs, turns)
    sequences = written(ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")), "sequences")
    prefixes = written(_prefixes(sequences, turns, before), "prefixes")

    proper = prefixes.where("depth < len").select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("conv_id", "depth")
    leaf = _blocks(leaves, "depth - 1").select("conv_id", "block", F.lit(1).alias("leaf"))
    nodes = prefixes.join(leaf, ["conv_id", "block"], "left").groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.coalesce(F.sum("leaf"), F.lit(0)).cast("long").alias("n_leaves"),
        F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
    )
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth"))
    children = written(children.agg(F.count("*").alias("n_children")), "children")

    none = hashlib.sha256().hexdigest()
    found = _with_parents(nodes, children).join(children, KEY, "left").join(_saved(prefixes, nodes, sequences), KEY).join(end_digests(ends), KEY, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
