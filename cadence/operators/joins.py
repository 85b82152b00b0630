"""Time-aware joins as compositions of equi-joins and windows.

Times are whole numbers (milliseconds). Null times and null keys match nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.scalars import hashed
from cadence.operators.ranking import with_count_before
from cadence.session import written

#: Queries that are broadcast at a time, or about so many.
QUERY_BLOCK = 10_000


def band_matched(left: DataFrame, right: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """`left` with a column `matched`: whether a right row of the same key lies within `width`, both ends included.

    Both sides are put into buckets of the width; each right time, once per distinct (key, time), is sent to its own
    bucket and both neighbours, so an equi-join on (key, bucket) finds every pair. Of a bucket only the nearest times
    matter, so the right side is first reduced to its least and greatest time per bucket: a left row meets three rows.
    """
    w = max(1, width)
    bucket = F.floor(F.col(time) / F.lit(w))
    spans = right.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), bucket.alias("_b"))
    spans = spans.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    # with buckets as wide as the band, a neighbour's nearest time is its greatest (before) or least (after)
    near = spans.select("_k", F.explode(F.array(*(F.struct((F.col("_b") + s).alias("_b"), F.lit(-s).alias("_side"), "_lo", "_hi") for s in (-1, 0, 1)))).alias("s")).select("_k", "s.*")
    near = near.groupBy("_k", "_b").agg(
        F.max(F.when(F.col("_side") == -1, F.col("_hi"))).alias("_before"), F.min(F.when(F.col("_side") == 1, F.col("_lo"))).alias("_after"),
        F.max(F.when(F.col("_side") == 0, F.lit(1))).alias("_same"),
    )
    t = F.col(time)
    hit = (F.col("_same") == 1) | (t - F.col("_before") <= width) | (F.col("_after") - t <= width)
    rows = left.withColumn("_bucket", bucket).join(near, (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    # inside one bucket times differ by less than the width
    return rows.withColumn("matched", F.coalesce(hit, F.lit(False))).drop("_bucket", "_k", "_b", "_before", "_after", "_same")


def asof(
    left: DataFrame,
    right: DataFrame,
    key: str,
    time: str,
    values: list[str],
    direction: str = "backward",
    strict: bool = False,
    shift: int = 0,
    seq: str | None = None,
    or_first: bool = False,
    bucket: int | None = None,
) -> DataFrame:
    """`left` with the `values` of the nearest right row of its key at or before (backward) or after (forward) its time.

    `strict` leaves out equal times; `shift` is added to the left time for the search. Of right rows at one time the
    one with the greatest `seq` counts (backward) or the smallest (forward); without `seq`, by their values.
    `or_first` takes the key's first right row where none qualifies. Both sides are united and swept by one window.

    With `bucket`, a length of time, a key's rows are dealt out by bucket too, so a frequent key is spread over tasks:
    what the buckets before (after) leave off with is worked out on a row per key and bucket, and each bucket's sweep
    starts with that.
    """
    back = direction == "backward"
    tie = [seq] if seq else []
    payload = F.struct(*tie, *(v for v in values if v not in tie))
    pick = (F.max if back else F.min)(payload)
    one = right.where(F.col(time).isNotNull()).groupBy(key, time).agg(pick.alias("_right"))
    # at equal times a right row comes first if it may be seen from there
    first = int(back != strict)
    rights = one.select(key, F.col(time).alias("_t"), F.lit(0 if first else 2).alias("_side"), "_right", F.lit(None).cast(_struct(left)).alias("_left"))
    lefts = left.select(
        key, (F.col(time) + shift).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(rights.schema["_right"].dataType).alias("_right"),
        F.struct(*left.columns).alias("_left"),
    )
    swept = rights.unionByName(lefts)
    group = [key]
    if bucket:
        swept = swept.withColumn("_bucket", F.floor(F.col("_t") / F.lit(bucket)))
        swept = swept.unionByName(_carries(swept, key, bucket, back, or_first))
        group, or_first = [key, "_bucket"], False
    order = Window.partitionBy(*group).orderBy("_t", "_side")
    frame = order.rowsBetween(Window.unboundedPreceding, 0) if back else order.rowsBetween(0, Window.unboundedFollowing)
    found = (F.last if back else F.first)("_right", ignorenulls=True).over(frame)
    if or_first:
        found = F.coalesce(found, F.first("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    swept = swept.withColumn("_found", F.when(F.col("_t").isNotNull(), found)).where("_left IS NOT NULL")
    return swept.select("_left.*", *(F.col("_found")[v].alias(v) for v in values))


def _carries(swept: DataFrame, key: str, bucket: int, back: bool, or_first: bool) -> DataFrame:
    """Rows like `swept` that stand at the start (the end, if not `back`) of each bucket of a key with the right value
    that the buckets before (after) it leave off with; with `or_first`, where there is none, the key's first."""
    at = F.when(F.col("_right").isNotNull(), F.col("_t"))
    ends = swept.where("_t IS NOT NULL").groupBy(key, "_bucket").agg((F.max_by if back else F.min_by)("_right", at).alias("_end"), F.min_by("_right", at).alias("_first"))
    order = Window.partitionBy(key).orderBy("_bucket")
    frame = order.rowsBetween(Window.unboundedPreceding, -1) if back else order.rowsBetween(1, Window.unboundedFollowing)
    carried = (F.last if back else F.first)("_end", ignorenulls=True).over(frame)
    if or_first:
        carried = F.coalesce(carried, F.first("_first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = ends.withColumn("_right", carried).where("_right IS NOT NULL")
    t = F.col("_bucket") * bucket if back else (F.col("_bucket") + 1) * bucket
    return rows.select(key, t.cast(swept.schema["_t"].dataType).alias("_t"), F.lit(-1 if back else 3).alias("_side"), "_right", F.lit(None).cast(swept.schema["_left"].dataType).alias("_left"), "_bucket")


def _struct(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields) + ">"


def merged(left: DataFrame, right: DataFrame, time: str, seq: str) -> DataFrame:
    """Both streams with `src` (0 left, 1 right); the order (time, src, seq) is the stable merge with left first at ties."""
    return left.withColumn("src", F.lit(0)).unionByName(right.withColumn("src", F.lit(1)))


#: Points of a block of interval containment.
POINTS = 4096


def containing(points: DataFrame, spans: DataFrame, key: str, time: str, start: str, end: str, block: int = POINTS) -> DataFrame:
    """Pairs of points and spans of one key with start <= time <= end.

    Points and ends of spans are swept in one order, and what a span contains is the points between two places of it. A
    span goes to each block of `block` points that it reaches into, so it costs a row and one more for each `block`
    pairs, however long it is. Rows with a null key or time and spans that end before they start have no pairs.
    """
    spans = spans.where(" AND ".join(f"{c} IS NOT NULL" for c in (key, start, end)) + f" AND {start} <= {end}")
    spans = written(spans.withColumn("_span", F.monotonically_increasing_id()), "spans")
    none = lambda t: F.lit(None).cast(t)
    at = lambda c, kind: (F.col(key).alias("_key"), F.col(c).alias("_t"), F.lit(kind).alias("_kind"))
    row = F.struct(*points.columns)
    swept = points.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(*at(time, 1), row.alias("_point"), none("long").alias("_span"))
    for c, kind in ((start, 0), (end, 2)):
        swept = swept.unionByName(spans.select(*at(c, kind), none(swept.schema["_point"].dataType).alias("_point"), "_span"))
    swept = written(with_count_before(swept.withColumn("_is", F.col("_kind") == 1), ["_key", "_t", "_kind"], "_is", "_at"), "swept")

    place = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_at")))
    reach = swept.where("_kind <> 1").groupBy("_span").agg(place(0).alias("_lo"), place(2).alias("_hi")).where("_lo < _hi")
    reach = reach.join(spans.drop(key), "_span").withColumn("_block", F.explode(F.sequence(F.expr(f"_lo div {block}"), F.expr(f"(_hi - 1) div {block}"))))
    held = swept.where("_kind = 1").select("_at", F.expr(f"_at div {block}").alias("_block"), "_point.*")
    return held.join(reach, "_block").where("_at >= _lo AND _at < _hi").drop("_block", "_span", "_lo", "_hi", "_at")


def sibling(df: DataFrame, set_col: str, id_col: str, seed: int) -> DataFrame:
    """(id, sibling): for each row another one of its set, by hash: the next in the set's hashed circle; none if alone."""
    order = Window.partitionBy(set_col).orderBy("_h", id_col)
    rows = df.select(set_col, id_col).withColumn("_h", hashed(seed, id_col))
    following = F.coalesce(F.lead(id_col).over(order), F.first(id_col).over(order))
    return rows.withColumn("sibling", following).where(F.col("sibling") != F.col(id_col)).select(id_col, "sibling")


#: Rows held against queries at a time, and rows of a first pass that bounds the distances.
ROWS, FIRST = 2048, 20_000
#: Pairs whose distance is estimated at a time, and numbers in the vectors of pairs that are worked out at a time.
PAIRS, NUMBERS = 1 << 20, 1 << 22


class _Best:
    """The k best (distance, id) of each query so far; a distance counts negative if the farthest are wanted."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, sign: int, bound: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.sign = ids, vectors, k, sign
        self.squares = (vectors**2).sum(axis=1)
        self.bound = np.full(len(ids), np.inf) if bound is None else bound
        self.key = np.full((len(ids), k), np.inf)
        self.id = np.full((len(ids), k), -1, "i8")

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Hold rows against all queries, so many at a time that PAIRS bounds the matrices, whatever the queries' number."""
        squares = (vectors**2).sum(axis=1)
        step = max(1, PAIRS // len(ids))
        for start in range(0, len(self.ids), step):
            self._add(slice(start, start + step), ids, vectors, squares)

    def _add(self, some: slice, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray) -> None:
        """By a product of matrices first, which is right but for rounding, and those that may be among the best once more."""
        sums = self.squares[some, None] + squares[None, :]
        rough = self.sign * (sums - 2 * (self.vectors[some] @ vectors.T))
        rough[self.ids[some, None] == ids[None, :]] = np.nan
        limit = np.minimum(self.key[some, -1], self.bound[some])
        edge = np.where(np.isinf(limit), np.inf, self.sign * limit**2)
        if np.isinf(edge).any() and self.k < len(ids):
            # without a bound yet: the k-th of these rows is one (nan sorts last, and is none)
            kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
            edge = np.fmin(edge, kth + 1e-9 * sums.max(axis=1))
        sums *= 1e-9
        sums += edge[:, None]
        q, r = np.nonzero(rough <= sums)
        step = max(1, NUMBERS // max(1, vectors.shape[1]))
        for start in range(0, len(q), step):
            self._take(q[start : start + step] + some.start, r[start : start + step], ids, vectors)

    def _take(self, q: np.ndarray, r: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Work out pairs of queries and rows one by one and keep the k best of each query."""
        exact = self.sign * np.sqrt(((self.vectors[q] - vectors[r]) ** 2).sum(axis=1))
        asked = np.unique(q)
        q = np.concatenate([np.repeat(asked, self.k), q])
        key, id_ = np.concatenate([self.key[asked].ravel(), exact]), np.concatenate([self.id[asked].ravel(), ids[r]])
        order = np.lexsort((id_, key, q))
        q, key, id_ = q[order], key[order], id_[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = place < self.k
        self.key[q[kept], place[kept]], self.id[q[kept], place[kept]] = key[kept], id_[kept]


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column have `size` numbers, and these as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = np.array([v is not None and len(v) == size and None not in v for v in lists.to_pylist()], bool) if lists.null_count or lists.flatten().null_count or len(lists.flatten()) != len(lists) * size else np.ones(len(lists), bool)
    flat = lists.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float)
    return good, flat.reshape(-1, size)


def neighbours(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, nearest: bool = True) -> DataFrame:
    """(query, id, distance, place): the k nearest (or farthest) rows of each query, ties by id, itself left out.

    Queries, about QUERY_BLOCK at a time by hash, are broadcast as a matrix. Each task holds its rows against them as
    blocks of matrices and keeps k best for each query, so no pair is sorted or leaves a task but those. The k best
    of FIRST rows bound what any task still has to keep. Ids are whole numbers, not null; vectors that are null, hold
    nulls or have another length than the queries' are no neighbours.
    """
    count = queries.count()
    blocks, out = max(1, -(-count // QUERY_BLOCK)), None
    for n in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == n)
        found = _neighbours(some, rows, id_col, vector, k, 1 if nearest else -1)
        found = found if blocks == 1 else written(found, "neighbours")
        out = found if out is None else out.unionByName(found)
    return out


def _neighbours(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, sign: int) -> DataFrame:
    spark = queries.sparkSession
    asked = queries.select(F.col(id_col).cast("long").alias("query"), vector).where(F.col("query").isNotNull() & F.col(vector).isNotNull()).toArrow()
    size = len(asked.column(1)[0]) if len(asked) else 0
    good, matrix = _vectors(asked.column(1), size) if len(asked) else (np.zeros(0, bool), np.zeros((0, 0)))
    if not good.all():
        raise ValueError("query vectors hold nulls or differ in length")
    shared = spark.sparkContext.broadcast((asked.column(0).to_numpy(), matrix))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), vector).where(F.col("id").isNotNull())

    def best(bound):
        def run(batches):
            found = _Best(*shared.value, k, sign, bound and bound.value)
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    kept, vectors = _vectors(part.column(1), size)
                    if len(vectors):
                        found.add(part.column(0).to_numpy(zero_copy_only=False)[kept], vectors)
            q, place = np.nonzero(np.isfinite(found.key))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.ids[q], found.id[q, place], sign * found.key[q, place])], ["query", "id", "distance"])

        return run

    schema = "query long, id long, distance double"
    if not len(asked):
        return spark.createDataFrame([], f"{schema}, place int")
    order = Window.partitionBy("query").orderBy(F.col("distance") * sign, "id")
    top = lambda df: df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    first = top(rows.limit(FIRST).mapInArrow(best(None), schema)).where(F.col("place") == k).select("query", "distance").toPandas()
    bounds = dict(zip(first["query"], first["distance"], strict=True))
    bound = spark.sparkContext.broadcast(np.array([sign * bounds[q] if q in bounds else np.inf for q in shared.value[0].tolist()]))
    return top(rows.mapInArrow(best(bound), schema))
