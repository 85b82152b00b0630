"""Catalogue queries: orders stand for charts, customers for sets, priorities for modes, prices for difficulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import filters, ranking
from cadence.plans.registry import query, table


@query("""WITH r AS (SELECT *, dense_rank() OVER (ORDER BY o_custkey) - 1 AS k FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM r WHERE k >= 100 AND k < 400""")
def split_by_set_rank(spark, d):
    return filters.by_set_rank(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", 100, 400).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def subset_by_ids(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return filters.by_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
AND o_orderdate >= DATE '1993-01-01' AND o_orderdate < DATE '1996-01-01' AND o_totalprice BETWEEN 50000 AND 200000""")
def catalog_filter(spark, d):
    found = filters.catalogue(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", ["1-URGENT", "2-HIGH"], (1993, 1995), (50000.0, 200000.0))
    return found.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000")
def min_difficulty(spark, d):
    return filters.catalogue(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", difficulty=(100000.0, None)).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_totalprice) >= 250000)")
def having_any_hard(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return filters.sets_with(orders, "o_custkey", F.max("o_totalprice") >= 250000).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def sets_with_siblings(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return filters.sets_with(orders, "o_custkey", F.count("*") > 1).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_per_set(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return filters.last_of_set(orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type NOT IN ('error', 'view')")
def event_exclude(spark, d):
    return filters.of_types(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["error", "view"], keep=False)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def event_include(spark, d):
    return filters.of_types(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type", ["click", "view"])


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:00:00'")
def time_slice(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return filters.time_range(table(spark, d, "events"), "ts", at("2024-01-05"), at("2024-01-09 12:00:00")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def trim_before_after(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return filters.time_range(table(spark, d, "events"), "ts", at("2024-01-05"), at("2024-01-20"), closed=True).select("event_id")


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'click' AND NOT ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15'
UNION ALL SELECT event_id, event_type FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15'""")
def fragment_replace(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    old, new = events.where("event_type = 'click'"), events.where("event_type = 'view'")
    return filters.replace_fragment(old, new, "ts", at("2024-01-10"), at("2024-01-15")).drop("ts")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '^[a-m]') AND NOT regexp_matches(lower(p_name), 'green|red')")
def regex_include_exclude(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").rlike("^(?!.*(?:green|red))[a-m]")).select("p_partkey", "p_name")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE regexp_matches(html, '<title>[^<]*(tion|ung)[^<]*</title>')")
def title_regex(spark, d):
    pages = table(spark, d, "pages").where(F.col("html").rlike("<title>[^<]*(tion|ung)[^<]*</title>"))
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""WITH t AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS tags FROM orders GROUP BY 1)
SELECT c_custkey FROM customer LEFT JOIN t ON c_custkey = o_custkey WHERE coalesce(list_contains(tags, '1-URGENT'), false)""")
def tag_membership(spark, d):
    tags = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("tags"))
    joined = table(spark, d, "customer").join(tags, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where(F.coalesce(F.array_contains("tags", "1-URGENT"), F.lit(False))).select("c_custkey")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.05 AND 0.2")
def bounding_box(spark, d):
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, d, "embeddings").where(x.between(-0.1, 0.1) & y.between(-0.05, 0.2)).select("vec_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def red_points(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id")


@query("""WITH w AS (SELECT user_id, list(event_type) AS labels FROM events GROUP BY 1)
SELECT user_id FROM w WHERE len(list_filter(labels, lambda x: x NOT IN ('view', 'click', 'error'))) > 0""")
def nonempty_windows(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("labels"))
    return rows.where(F.exists("labels", lambda x: ~x.isin("view", "click", "error"))).select("user_id")


@query("SELECT event_id, value FROM events WHERE value > 20 AND value < 100")
def plausibility_band(spark, d):
    return table(spark, d, "events").where("value > 20 AND value < 100").select("event_id", "value")


@query("""WITH e AS (SELECT event_id, user_id, ts, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS f FROM events)
SELECT event_id, user_id FROM e WHERE ts >= f""")
def drop_before_first_red(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return filters.from_first(events, "user_id", "ts", F.col("event_type") == "purchase").select("event_id", "user_id")


@query("""WITH l AS (SELECT d.doc_id, l.quality::DOUBLE AS quality, l.toxic::DOUBLE AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(quality, 0.5) AS quality, coalesce(toxic, 0.25) AS toxic, coalesce(nullif(quality, 0), 9) AS quality_nonzero FROM l""")
def default_fill(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    rows = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").withColumn("quality_nonzero", F.col("quality"))
    return rows.select("doc_id", *filters.filled({"quality": 0.5, "toxic": 0.25}), *filters.filled({"quality_nonzero": 9.0}, zero_is_missing=True))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag <> 'N' THEN 'flag=' || l_returnflag END, CASE WHEN l_linestatus <> 'O' THEN 'status=' || l_linestatus END) AS settings
FROM m WHERE l_returnflag <> 'N' OR l_linestatus <> 'O'""")
def non_default_settings(spark, d):
    own = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    changed = filters.non_default(own, F.create_map(F.lit("flag"), F.lit("N"), F.lit("status"), F.lit("O")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", changed.alias("m")).where(F.size("m") > 0)
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("l_orderkey", "l_linenumber", text.alias("settings"))


@query("""WITH f AS (SELECT o_clerk, row_number() OVER (ORDER BY first, o_clerk) - 1 AS code FROM (SELECT o_orderpriority AS o_clerk, min(o_orderkey) AS first FROM orders GROUP BY 1))
SELECT o_clerk AS o_orderpriority, code FROM f""")
def dict_encode(spark, d):
    return ranking.dictionary(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


@query("""WITH w AS (SELECT doc_id, i, string_split(coalesce(source, ''), 'r') AS t, unnest(string_split(lang || '-' || source, '-')) AS tag, unnest(range(2)) AS i2 FROM documents, (SELECT 0 AS i)),
f AS (SELECT tag, min(doc_id * 10 + i2) AS first FROM w GROUP BY tag), c AS (SELECT tag, row_number() OVER (ORDER BY first, tag) - 1 AS code FROM f)
SELECT doc_id, string_agg(code::VARCHAR, ',' ORDER BY i2) AS codes FROM w JOIN c USING (tag) GROUP BY doc_id""")
def explode_unique_index(spark, d):
    tags = table(spark, d, "documents").select("doc_id", F.posexplode(F.array("lang", "source")).alias("i", "tag")).where("tag IS NOT NULL")
    tags = tags.withColumn("at", F.col("doc_id") * 10 + F.col("i"))
    codes = tags.join(ranking.dictionary(tags, "tag", "at"), "tag")
    listed = codes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "code"))).alias("c"))
    return listed.select("doc_id", F.array_join(F.transform("c", lambda x: x["code"].cast("string")), ",").alias("codes"))


@query("SELECT o_custkey, o_orderkey FROM orders ORDER BY 1, 2")
def sort_by_set_and_id(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey")
