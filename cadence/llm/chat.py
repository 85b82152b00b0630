"""Chat formatting by folding an event log.

A conversation is a log of events, each for one message (its turn, and `nth` among messages of that turn):
`start` names the role, `delta` appends streamed text, `edit` replaces the text, `regenerate` drops it so that later
deltas build it anew. Folding a message's events in order of `seq` gives its final text. Messages are then rendered
with markers around each turn, and control strings inside texts are escaped so that they can be read back.

Folding groups by message and rendering by blocks of turns, so one very long conversation is spread over many groups.
All is done by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a block; texts of conversations are kept in blocks.
BLOCK_TURNS = 128


def escape(text: Column) -> Column:
    r"""Every `<|`, `<\|`, `<\\|`, ... gets one more backslash, so no `<|` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def events_of(conversations: DataFrame, delta_chars: int = 1024) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): a start and deltas of `delta_chars` characters.

    Rows with the same turn are messages of their own, ordered by role and text. Null texts give no delta.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("nth", nth)
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.col("role").alias("role"), none.alias("text"))
    deltas = F.transform(
        parts, lambda part, i: F.struct((i + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"), none.alias("role"), part.alias("text"))
    )
    events = F.concat(F.array(start), deltas)
    return rows.select("conv_id", "turn", "nth", F.inline(events))


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, nth, role, text) from events (conv_id, turn, nth, seq, kind, role, text).

    The text starts at the last edit or regenerate, if any. The role is the first that an event names, else empty.
    Null texts count as empty; null conv_id, turn and nth are values of their own. Events with equal seq are ordered
    by kind and text.
    """
    resets = F.when(F.col("kind").isin("edit", "regenerate"), F.struct("seq", "kind", "text"))
    log = events.groupBy("conv_id", "turn", "nth").agg(
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.max(resets).alias("reset"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "kind", "text")))).alias("deltas"),
    )
    after = F.filter("deltas", lambda d: F.col("reset").isNull() | (d.seq > F.col("reset.seq")))
    base = F.when(F.col("reset.kind") == "edit", F.col("reset.text"))
    text = F.concat(F.coalesce(base, F.lit("")), F.array_join(F.transform(after, lambda d: d.text), ""))
    return log.select("conv_id", "turn", "nth", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",), block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Formatted conversations in blocks of turns: conv_id, block, formatted, spans.

    A turn is `<|im_start|>role`, line feed, text, `<|im_end|>`, line feed, with the role URL-encoded (plain roles
    don't change) and the text escaped. `spans` is the loss mask: start and length, in code points of the block's
    formatted text, of each text of a role in `trained`. Blocks of a conversation follow one another by `block`.
    """
    role = F.url_encode(F.col("role"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turn = F.struct(
        "turn", "nth", head.alias("head"), escape(F.col("text")).alias("text"), F.col("role").isin(*trained).alias("loss"),
    )
    blocks = (
        messages.withColumn("block", F.floor(F.col("turn") / F.lit(block_turns)))
        .groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "")
    end = len(END) + 1
    none = F.array().cast("array<struct<start:long,length:long>>")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["text"]) + end).cast("long").alias("at"),
            F.when(
                t["loss"],
                F.concat(
                    a["spans"],
                    F.array(F.struct((a["at"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["text"]).cast("long").alias("length"))),
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return blocks.select("conv_id", "block", formatted.alias("formatted"), spans.alias("spans"))


def parse(blocks: DataFrame) -> DataFrame:
    """Read rendered blocks: conv_id, block, turns (role, text) and loss_text (texts under the mask, one after another)."""
    chunks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)

    def turn(chunk: Column) -> Column:
        role = F.substring_index(chunk, "\n", 1)
        body = F.substring(chunk, F.length(role) + 2, F.length(chunk) - F.length(role) - 1 - (len(END) + 1))
        return F.struct(F.url_decode(role).alias("role"), unescape(body).alias("text"))

    cut = F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return blocks.select(
        "conv_id", "block", F.transform(chunks, turn).alias("turns"), F.array_join(cut, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation, read back from rendered blocks: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = parse(blocks).select(
        "conv_id", "block", F.size("turns").alias("n"), plain.alias("plain"), "loss_text", "formatted_chars"
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("block", "plain", "loss_text"))).alias("b"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    loss = F.array_join(F.col("b.loss_text"), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("b.plain"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
