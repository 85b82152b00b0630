"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few tokens in a row that looks at some positions and ignores the others, so a text in
which an ignored token was replaced has the same hash. Hashes of all positions of the benchmark and of the documents
are joined; a hit gives an item and a shift, and the item is laid over the document at that shift. The document is
contaminated if, in some window of `window` tokens of the overlap, at most `max_substitutions` differ.

The two masks were chosen by trying all pairs: in every 13 tokens with any 2 of them replaced, one mask fits somewhere
without meeting a replaced token, so a window that the check would accept is never missed by the seeds. Items of 8 to 12
tokens have masks of their own, chosen in the same way.

A place of a text whose surroundings repeat those a few tokens before (a run of one token, a few tokens in turn) says
nothing new: a window accepted there is accepted at the place before too. Such places have no seeds, on either side, so
a run costs its ends and not its length, and two runs don't meet at every pair of places.

Everything is DataFrame work. The benchmark's hashes are counted and broadcast in parts of a bounded size, each over
all documents, so that positions of documents are never shuffled, whatever the size of the benchmark. The documents with
hits, whose texts are read again for the check, are broadcast if they are few and else joined by shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.session import written

#: Positions that each mask looks at.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
SPAN = 8
#: Masks for items of 8 to 12 tokens, by trying all replacements of a fifth of the tokens: one mask always fits.
SHORT_MASKS = {
    8: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)), 9: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6)), 10: ((0, 1, 2, 3), (0, 1, 2, 4)),
    11: ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)), 12: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
}
#: Rows of a join's side up to which it is broadcast (24 bytes or so each).
BROADCAST_ROWS = 1_000_000
#: Items with fewer tokens are not looked for; too_short() lists them.
LEAST_TOKENS = 4
#: Runs of up to so many tokens in turn are told by their first places.
PERIODS = 4


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _places(hashes: Column, window: int) -> Column:
    """Array of the positions of an array of token hashes but those where all that a window around them could hold lies
    a period before as well; null if that are all positions.

    Such a position has repeats on window - 1 positions to both sides, so a block of `window` positions from a multiple
    of `window` on repeats as a whole. Only texts with such a block are looked through.
    """
    n = F.size(hashes)

    def repeats(period: int):
        return lambda k: F.coalesce(F.get(hashes, k) == F.get(hashes, k - period), F.lit(False))

    def told(i: Column, first: Column, last: Column) -> Column:
        each = [repeats(period)(i) & F.forall(F.sequence(first, last), repeats(period)) for period in range(1, PERIODS + 1)]
        return reduce(Column.__or__, each)

    block = F.exists(F.sequence(F.lit(0), n, F.lit(window)), lambda k: told(k, k, k + (window - 1)))
    new = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~told(i, i - (window - 1), i + (window - 1)))
    return F.when((n >= window) & block, new)


def _seeds(hashes: Column, places: Column, masks: list[tuple[int, ...]]) -> Column:
    """Array of (at, hash) of each mask at each of `places` (null: all) of an array of token hashes."""
    parts = []
    for mask in masks:
        last = F.size(hashes) - (mask[-1] + 1)
        every = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        at = F.when(places.isNull(), every).otherwise(F.filter(places, lambda i: i <= last))  # noqa: B023
        parts.append(F.transform(at, _seed(hashes, mask)))
    return F.concat(*parts)


def _seed(hashes: Column, mask: tuple[int, ...]):
    salt = F.lit(",".join(map(str, mask)))
    return lambda i: F.struct(i.alias("at"), F.xxhash64(salt, *(F.get(hashes, i + k) for k in mask)).alias("seed"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def too_short(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n_tokens) of the items that contamination() does not look for; null and empty texts have 0 tokens."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.size(tokens_of(F.col(text_col))).cast("long").alias("n_tokens"))
    return rows.where(F.col("n_tokens") < LEAST_TOKENS)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    max_substitutions: int = 2,
) -> DataFrame:
    """(id, key, item) of documents that hold a passage of a benchmark item; key is a hash of the id and the text.

    Tokens are runs of letters and digits in lower case. Items shorter than `window` must lie in the document whole,
    with at most a fifth of their tokens replaced (rounded down); items under 8 tokens are matched without any, and
    items under 4 are not looked for (see too_short()). Null or empty texts and items match nothing. Documents with null or repeated
    ids are told apart by their texts. Further columns are not read.
    """
    items = benchmark.select(F.col(item_col).alias("item"), tokens_of(F.col(item_text_col)).alias("item_tokens")).where(F.size("item_tokens") >= LEAST_TOKENS)
    items = written(items, "items")
    lengths = [r.n for r in items.where(F.size("item_tokens") <= max(SHORT_MASKS)).select(F.size("item_tokens").alias("n")).distinct().collect()]
    masks = [*MASKS, *(tuple(range(n)) for n in lengths if n < SPAN)]
    own = {n: SHORT_MASKS[n] for n in sorted(lengths) if n in SHORT_MASKS}
    hashed = items.withColumn("hashes", F.transform("item_tokens", lambda t: F.xxhash64(t)))
    hashed = hashed.withColumn("places", _places(F.col("hashes"), window))
    seeds = hashed.select("item", F.inline(_seeds(F.col("hashes"), F.col("places"), masks)))
    for n, more in own.items():
        seeds = seeds.unionByName(hashed.where(F.size("hashes") == n).select("item", F.inline(_seeds(F.col("hashes"), F.col("places"), list(more)))))
    masks = list(dict.fromkeys([*masks, *(m for more in own.values() for m in more)]))
    seeds = written(seeds.select("item", F.col("at").alias("item_at"), "seed").distinct(), "seeds")
    n_seeds = seeds.count()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    hashes = F.transform(tokens_of(F.col("text")), lambda t: F.xxhash64(t))
    hashed = rows.select("id", "key", hashes.alias("hashes")).withColumn("places", _places(F.col("hashes"), window))
    exploded = hashed.select("id", "key", F.inline(_seeds(F.col("hashes"), F.col("places"), masks)))
    # every position meets every part of the seeds, so the documents' own positions are never shuffled
    parts, hits = max(1, -(-n_seeds // BROADCAST_ROWS)), None
    for n in range(parts):
        part = seeds if parts == 1 else seeds.where(F.pmod(F.xxhash64("seed", "item", "item_at"), F.lit(parts)) == n)
        met = exploded.join(F.broadcast(part), "seed").select("id", "key", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        met = written(met.distinct(), "hits")
        hits = met if hits is None else hits.unionByName(met)
    hits = hits if parts == 1 else written(hits.distinct(), "hits")
    found = hits.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).distinct()
    again = rows.join(_small(found, found.count()), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left_semi")
    again = again.dropDuplicates(["id", "key"]).select(F.col("id").alias("doc"), F.col("key").alias("doc_key"), tokens_of(F.col("text")).alias("tokens"))
    laid = hits.join(again, F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("doc_key"))).join(_small(items, n_seeds), "item")

    width = F.least(F.lit(window), F.size("item_tokens"))
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("item_tokens"), F.size("tokens") - F.col("shift")) - 1
    differs = F.transform(
        F.sequence(first, last),
        lambda j: F.when(F.get(F.col("tokens"), j + F.col("shift")) == F.get(F.col("item_tokens"), j), F.lit(0)).otherwise(F.lit(1)),
    )
    allowed = F.when(F.size("item_tokens") < SPAN, F.lit(0)).when(F.size("item_tokens") < window, F.floor(F.size("item_tokens") / F.lit(5))).otherwise(F.lit(max_substitutions))
    laid = laid.where(last - first + 1 >= width).select("id", "key", "item", differs.alias("d"), width.alias("w"), allowed.alias("allowed"))
    fits = F.exists(
        F.sequence(F.lit(1), F.size("d") - F.col("w") + 1),
        lambda s: F.aggregate(F.slice(F.col("d"), s, F.col("w")), F.lit(0), lambda a, x: a + x) <= F.col("allowed"),
    )
    return laid.where(fits).select("id", "key", "item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per document: id, kept (false if contaminated), n_items, item_ids (ascending), and the columns in `keep`.

    See contamination() for `options` and for nulls, ties and empty texts. `keep` must not hold the result's names.
    """
    found = contamination(docs, benchmark, id_col, text_col, **options)
    found = found.groupBy("id", "key").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    found = written(found, "contaminated")
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True))
    )
    side = _small(found.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "item_ids"), found.count())
    joined = rows.join(side, F.col("_id").eqNullSafe(F.col("hit_id")) & (F.col("_key") == F.col("hit_key")), "left")
    none = F.array().cast("array<long>")
    return joined.select(
        F.col("_id").alias(id_col), F.col("item_ids").isNull().alias("kept"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
        F.coalesce(F.col("item_ids").cast("array<long>"), none).alias("item_ids"), *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)),
    )
