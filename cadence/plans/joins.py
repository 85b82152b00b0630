"""Join queries. Events' users are charts; their times are milliseconds from the start of 2024."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import joins
from cadence.plans.registry import query, table

MS = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000"
E = "e AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS ms FROM events)"


#: Milliseconds by which a user's events are dealt out in as-of joins.
DAY = 86_400_000


def events(spark, d):
    return table(spark, d, "events").withColumn("ms", F.expr(MS))


@query("""WITH t AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tags FROM orders GROUP BY 1)
SELECT c_custkey, tags FROM customer LEFT JOIN t ON c_custkey = o_custkey""")
def tag_list_left_join(spark, d):
    tags = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("tags"))
    return table(spark, d, "customer").join(tags, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "tags")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def dim_lookup_default(spark, d):
    dim = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id").join(dim, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def inner_skip_missing(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS overlapping, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS fresh FROM documents")
def overlap_report(spark, d):
    seen = table(spark, d, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    rows = table(spark, d, "documents").select("doc_id").join(seen, "doc_id", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if("seen").alias("overlapping"), F.count_if(F.col("seen").isNull()).alias("fresh"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def anti_removed(spark, d):
    removed = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang").join(removed, "doc_id", "left_anti")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, md5('7:' || o_orderkey) AS h FROM orders),
s AS (SELECT o_orderkey, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS sibling FROM h WINDOW w AS (PARTITION BY o_custkey ORDER BY h, o_orderkey)) SELECT * FROM s WHERE sibling <> o_orderkey""")
def random_sibling(spark, d):
    return joins.sibling(table(spark, d, "orders"), "o_custkey", "o_orderkey", seed=7)


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey, n - 1 AS others FROM orders JOIN n USING (o_custkey)""")
def other_charts_in_set(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sizes = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return orders.join(sizes, "o_custkey").select("o_orderkey", (F.col("n") - 1).alias("others"))


def rhythm_scores(real, made, key: str, time: str, width: int):
    """True and false positives and false negatives by a band join, then precision, recall and F1 (0 where 0 / 0)."""
    zero = F.lit(0).cast("long")
    hits = joins.band_matched(real, made, key, time, width).agg(F.count_if("matched").alias("tp"), zero.alias("fp"), F.count_if(~F.col("matched")).alias("fn"))
    extra = joins.band_matched(made, real, key, time, width).agg(zero.alias("tp"), F.count_if(~F.col("matched")).alias("fp"), zero.alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    scored = hits.unionByName(extra).agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    scored = scored.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    f1 = ratio(2 * c("precision") * c("recall"), c("precision") + c("recall"))
    return scored.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


@query(f"""WITH {E}, r AS (SELECT user_id, ms FROM e WHERE event_type = 'click'), g AS (SELECT user_id, ms FROM e WHERE event_type = 'view'),
a AS (SELECT EXISTS (SELECT 1 FROM g WHERE g.user_id = r.user_id AND g.ms BETWEEN r.ms - 1800000 AND r.ms + 1800000) AS m FROM r),
b AS (SELECT EXISTS (SELECT 1 FROM r WHERE g.user_id = r.user_id AND r.ms BETWEEN g.ms - 1800000 AND g.ms + 1800000) AS m FROM g),
c AS (SELECT (SELECT count(*) FROM a WHERE m) AS tp, (SELECT count(*) FROM b WHERE NOT m) AS fp, (SELECT count(*) FROM a WHERE NOT m) AS fn),
s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM s""")
def band_precision_recall(spark, d):
    rows = events(spark, d).select("user_id", "ms", "event_type")
    return rhythm_scores(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "user_id", "ms", 1_800_000)


def _sides(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "ms", "event_type", "value")
    left = rows.where("event_type = 'view'").select("event_id", "user_id", "ms")
    right = rows.where("event_type = 'purchase'").select("user_id", "ms", F.col("event_id").alias("seq"), F.col("value").alias("found"))
    return left, right


_SIDES = f"WITH {E}, l AS (SELECT event_id, user_id, ms FROM e WHERE event_type = 'view'), r AS (SELECT user_id, ms, value AS found, event_id AS seq FROM e WHERE event_type = 'purchase')"


@query(f"{_SIDES}, f AS (SELECT user_id, arg_min(found, ms) AS first FROM r GROUP BY 1), a AS (SELECT l.event_id, l.user_id, r.found FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ms >= r.ms) SELECT event_id, coalesce(found, first) AS found FROM a LEFT JOIN f USING (user_id)")
def asof_back_incl(spark, d):
    left, right = _sides(spark, d)
    return joins.asof(left, right, "user_id", "ms", ["found"], seq="seq", or_first=True, bucket=DAY).select("event_id", "found")


@query(f"{_SIDES} SELECT event_id, coalesce(found, 0) AS found FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ms > r.ms")
def asof_back_strict(spark, d):
    left, right = _sides(spark, d)
    return joins.asof(left, right, "user_id", "ms", ["found"], strict=True, seq="seq", bucket=DAY).select("event_id", F.coalesce("found", F.lit(0.0)).alias("found"))


@query(f"{_SIDES} SELECT event_id, found FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ms < r.ms")
def asof_fwd_strict(spark, d):
    left, right = _sides(spark, d)
    return joins.asof(left, right, "user_id", "ms", ["found"], direction="forward", strict=True, seq="seq", bucket=DAY).select("event_id", "found")


@query(f"{_SIDES} SELECT event_id, found FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ms + 3600000 >= r.ms")
def asof_shifted(spark, d):
    left, right = _sides(spark, d)
    return joins.asof(left, right, "user_id", "ms", ["found"], seq="seq", shift=3_600_000, bucket=DAY).select("event_id", "found")


@query(f"""WITH {E}, p AS (SELECT event_id, user_id, ms, event_type = 'purchase' AS red, value FROM e WHERE event_type IN ('purchase', 'signup')),
q AS (SELECT event_id, user_id, ms FROM e WHERE event_type = 'view'),
a AS (SELECT q.event_id, p.red, p.value FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.ms >= p.ms)
SELECT event_id, round(CASE WHEN red OR red IS NULL THEN 1.0 ELSE least(greatest(value / 100, 0.01), 10) END, 6) AS speed FROM a""")
def scroll_speed_at(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "ms", "event_type", "value")
    points = rows.where("event_type IN ('purchase', 'signup')").select("user_id", "ms", F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("red"), "value")
    found = joins.asof(rows.where("event_type = 'view'").select("event_id", "user_id", "ms"), points, "user_id", "ms", ["red", "value"], seq="seq", bucket=DAY)
    speed = F.when(F.coalesce("red", F.lit(True)), F.lit(1.0)).otherwise(F.least(F.greatest(F.col("value") / 100, F.lit(0.01)), F.lit(10.0)))
    return found.select("event_id", F.round(speed, 6).alias("speed"))


@query(f"""WITH {E}, u AS (SELECT user_id, 0 AS src, event_id, ms FROM e WHERE event_type = 'click' UNION ALL SELECT user_id, 1, event_id, ms FROM e WHERE event_type = 'view')
SELECT event_id, src, row_number() OVER (PARTITION BY user_id ORDER BY ms, src, event_id) AS place FROM u""")
def merge_streams(spark, d):
    from pyspark.sql.window import Window

    rows = events(spark, d).select("user_id", "event_id", "ms", "event_type")
    both = joins.merged(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), "ms", "event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "src", "event_id"))
    return both.select("event_id", "src", place.alias("place"))


@query(f"WITH {E} SELECT event_id, ceil(ms * 0.0001)::BIGINT AS frame FROM e")
def frame_alignment(spark, d):
    return events(spark, d).select("event_id", F.ceil(F.col("ms") * F.lit(0.0001).cast("double")).cast("long").alias("frame"))


_PAIRS = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, b.vec_id AS id, list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM q JOIN embeddings b ON q.vec_id <> b.vec_id)
SELECT query, id, round(dist, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY dist {}, id) AS place FROM p QUALIFY place <= 5"""


def _neighbours(spark, d, nearest):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = joins.neighbours(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5, nearest)
    return found.withColumn("distance", F.round("distance", 6))


@query(_PAIRS.format("DESC"))
def pairwise_farthest(spark, d):
    return _neighbours(spark, d, False)


@query(_PAIRS.format(""))
def nearest_k(spark, d):
    return _neighbours(spark, d, True)


@query("""WITH missing AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'N')),
files AS (SELECT l_orderkey, min(l_linenumber) AS line FROM lineitem GROUP BY 1)
SELECT m.o_orderkey, f.line FROM missing m JOIN files f ON m.o_orderkey = f.l_orderkey""")
def repair_join(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    good = lines.where("l_linenumber = 1 AND l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    missing = table(spark, d, "orders").select("o_orderkey").join(good, "o_orderkey", "left_anti")
    first = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("line"))
    return missing.join(first, "o_orderkey")


@query("""SELECT o_orderkey, coalesce(n_name, 'Unknown') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 3""")
def inverse_index_lookup(spark, d):
    names = table(spark, d, "nation").where("n_regionkey <> 3").select("n_nationkey", "n_name")
    index = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(index, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.coalesce("n_name", F.lit("Unknown")).alias("name"))


@query(f"""WITH {E}, s AS (SELECT event_id AS span_id, user_id, ms AS start, ms + 7200000 AS stop FROM e WHERE event_type = 'signup')
SELECT e.event_id, span_id FROM e JOIN s ON e.user_id = s.user_id AND e.ms BETWEEN start AND stop WHERE event_type = 'click'""")
def interval_containment(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    spans = rows.where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", F.col("ms").alias("start"), (F.col("ms") + 7_200_000).alias("stop"))
    points = rows.where("event_type = 'click'").select("event_id", "user_id", "ms")
    return joins.containing(points, spans, "user_id", "ms", "start", "stop").select("event_id", "span_id")


@query(f"""WITH {E}, q AS (SELECT event_id, user_id, ms FROM e WHERE event_type = 'error'), p AS (SELECT user_id, ms, value FROM e WHERE event_type = 'purchase' AND value > 0)
SELECT q.event_id, arg_min(p.ms, abs(p.ms - q.ms) / p.value) AS nearest FROM q JOIN p ON q.user_id = p.user_id GROUP BY 1""")
def nearest_weighted(spark, d):
    from cadence.operators.beats import nearest_by_loss

    rows = events(spark, d).select("event_id", F.col("user_id").alias("track"), "ms", "event_type", "value")
    peaks = rows.where("event_type = 'purchase' AND value > 0").select("track", F.col("ms").alias("place"), F.col("value").alias("prominence"))
    queries = rows.where("event_type = 'error'").select("track", F.col("event_id").alias("id"), F.col("ms").alias("time_ms"))
    return nearest_by_loss(queries, peaks).select(F.col("id").alias("event_id"), F.col("place").alias("nearest"))
