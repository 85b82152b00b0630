"""Aggregate and evaluation queries."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.operators import aggregates as agg
from cadence.operators import ranking
from cadence.operators import windows as win
from cadence.plans.joins import E, events
from cadence.plans.registry import query, table

#: Predictions stand in for a model's: a label is an event's value in whole units, a prediction its neighbour's.
_PRED = f"{E}, p AS (SELECT event_id, user_id, event_type, value, trunc(value)::INT AS label, coalesce(trunc(lead(value) OVER (PARTITION BY user_id ORDER BY ms, event_id))::INT, -100) AS pred FROM e)"


def predictions(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "event_type", "value", "ms")
    following = F.lead("value").over(Window.partitionBy("user_id").orderBy("ms", "event_id"))
    return rows.select("event_id", "user_id", "event_type", "value", F.col("value").cast("int").alias("label"), F.coalesce(following.cast("int"), F.lit(-100)).alias("pred"))


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def group_to_list(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    return rows.select("o_custkey", "n", F.array_join(F.col("k").cast("array<string>"), ",").alias("keys"))


@query("SELECT o_custkey, o_totalprice AS upper_median FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 = count(*) OVER (PARTITION BY o_custkey) // 2")
def upper_median(spark, d):
    return agg.upper_median(table(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n FROM c WHERE n = (SELECT max(n) FROM c)")
def argmax_ties(spark, d):
    return agg.most_frequent(table(spark, d, "orders"), "o_custkey")


@query("SELECT count(DISTINCT o_custkey) AS sets, count(DISTINCT o_orderdate::DATE) AS days FROM orders")
def count_distinct(spark, d):
    return table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("sets"), F.countDistinct(F.to_date("o_orderdate")).alias("days"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1")
def dup_keys(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey", "l_partkey"))).where("n > 1").drop("n")


@query("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def describe(spark, d):
    x = "o_totalprice"
    return table(spark, d, "orders").agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))


@query("SELECT least(floor(l_quantity / 1.0 - 0)::INT, 49) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def hist_closed(spark, d):
    rows = table(spark, d, "lineitem").select(agg.closed_bin(F.col("l_quantity"), 0, 50, 50).alias("bin"))
    return rows.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS k, count(*) OVER () AS n FROM documents), q(q) AS (VALUES (0.0), (0.01), (0.1), (0.25), (0.5), (0.75), (0.9), (0.99), (1.0))
SELECT q::DOUBLE AS q, n_chars FROM q JOIN v ON k = least(floor(n * q), n - 1)""")
def order_stats(spark, d):
    return ranking.order_statistics(table(spark, d, "documents"), "n_chars", [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])


@query(f"WITH {E} SELECT ms // 3600000 AS hour, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM e GROUP BY 1")
def time_counts(spark, d):
    kinds = ["click", "purchase", "view"]
    rows = events(spark, d).select(F.expr("ms div 3600000").alias("hour"), "event_type")
    return rows.groupBy("hour").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))


@query(f"""WITH {E}, p AS (SELECT event_id, user_id, ms FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, ms, value FROM e WHERE event_type = 'view'),
h AS (SELECT event_id, least(floor(value / 50)::INT, 9) AS bin, count(*) AS n FROM p JOIN v ON p.user_id = v.user_id AND v.ms > p.ms - 86400000 AND v.ms < p.ms + 86400000 WHERE value BETWEEN 0 AND 500 GROUP BY ALL),
m AS (SELECT event_id, max(n) AS top, sum(n) AS total, min(CASE WHEN n = t THEN bin END) AS bin FROM (SELECT *, max(n) OVER (PARTITION BY event_id) AS t FROM h) GROUP BY 1)
SELECT event_id, coalesce(CASE WHEN top > 0.4 * total THEN bin END, -1) AS mode FROM p LEFT JOIN m USING (event_id)""")
def windowed_mode(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "ms", "event_type", "value")
    peaks = rows.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ms") - 86_399_999).alias("lo"), (F.col("ms") + 86_399_999).alias("hi"))
    views = rows.where("event_type = 'view'").select("user_id", "ms", agg.closed_bin(F.col("value"), 0, 500, 10).alias("bin"))
    near = win.counts_between(peaks, views, "user_id", "ms", "lo", "hi", "bin", 10)
    top, total = F.array_max("counts"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    mode = F.when(top > F.lit(0.4) * total, (F.array_position("counts", top) - 1).cast("int"))
    return near.select("event_id", F.coalesce(mode, F.lit(-1)).alias("mode"))


@query("WITH w AS (SELECT l_orderkey, l_linenumber, least(greatest(l_discount, 0.02), 0.08) AS w FROM lineitem) SELECT l_orderkey, l_linenumber, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w")
def mean_normalized_weights(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("weight"))
    return agg.mean_one(rows, "weight", 0.02, 0.08).withColumn("weight", F.round("weight", 6))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def mean_by_key(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {_PRED} SELECT round(avg((pred = label)::INT), 6) AS accuracy FROM p WHERE label >= 10 AND label < 60")
def acc_exact(spark, d):
    rows = predictions(spark, d).where("label >= 10 AND label < 60")
    return rows.agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy"))


@query(f"WITH {_PRED} SELECT round(avg((abs(pred - label) <= 5)::INT), 6) AS accuracy FROM p WHERE label >= 10 AND label < 60")
def acc_fuzzy(spark, d):
    rows = predictions(spark, d).where("label >= 10 AND label < 60")
    return rows.agg(F.round(F.avg((F.abs(F.col("pred") - F.col("label")) <= 5).cast("int")), 6).alias("accuracy"))


@query(f"WITH {_PRED} SELECT event_type, round(avg((pred = label)::INT), 6) AS exact, round(avg((abs(pred - label) <= 2)::INT), 6) AS near, count(*) AS n FROM p GROUP BY 1")
def metrics_by_family(spark, d):
    off = F.abs(F.col("pred") - F.col("label"))
    return predictions(spark, d).groupBy("event_type").agg(
        F.round(F.avg((off == 0).cast("int")), 6).alias("exact"), F.round(F.avg((off <= 2).cast("int")), 6).alias("near"), F.count("*").alias("n")
    )


@query(f"WITH {_PRED} SELECT round(sum(abs(pred - label) * value) / count(*) FILTER (pred <> -100), 6) AS loss FROM p")
def weighted_loss(spark, d):
    rows = predictions(spark, d)
    return rows.agg(F.round(F.sum(F.abs(F.col("pred") - F.col("label")) * F.col("value")) / F.count_if(F.col("pred") != -100), 6).alias("loss"))


@query(f"""WITH {_PRED} SELECT least(floor(value / 5)::INT, 19) + 1 AS bin, sum((pred = label)::INT)::BIGINT AS hits, count(*) AS n FROM p WHERE value >= 0 AND value < 100 GROUP BY 1""")
def acc_binned(spark, d):
    rows = predictions(spark, d).withColumn("bin", agg.digitized(F.col("value"), [5.0 * i for i in range(21)])).where("bin BETWEEN 1 AND 20")
    return rows.groupBy("bin").agg(F.sum((F.col("pred") == F.col("label")).cast("long")).alias("hits"), F.count("*").alias("n"))


@query(f"WITH {_PRED}, o AS (SELECT unnest(range(-3, 4)) AS shift) SELECT shift, round(count(*) FILTER (pred - label = shift) / count(*), 6) AS share FROM p, o GROUP BY 1")
def offset_precision(spark, d):
    diff = F.col("pred") - F.col("label")
    one = predictions(spark, d).agg(F.count("*").alias("n"), *(F.count_if(diff == s).alias(f"s{s + 3}") for s in range(-3, 4)))
    pairs = F.array(*(F.struct(F.lit(s).cast("long").alias("shift"), F.col(f"s{s + 3}").alias("k")) for s in range(-3, 4)))
    return one.select("n", F.inline(pairs)).select("shift", F.round(F.col("k") / F.col("n"), 6).alias("share"))


@query(f"""WITH {_PRED}, c AS (SELECT user_id, avg(value) / 20 AS complexity FROM p GROUP BY 1)
SELECT least(floor(complexity)::INT, 19) AS bin, round(avg((pred = label)::INT), 6) AS accuracy, count(*) AS n FROM p JOIN c USING (user_id) GROUP BY 1""")
def acc_by_complexity(spark, d):
    rows = predictions(spark, d)
    complexity = rows.groupBy("user_id").agg((F.avg("value") / 20).alias("c"))
    rows = rows.join(complexity, "user_id").withColumn("bin", F.least(F.floor("c").cast("int"), F.lit(19)))
    return rows.groupBy("bin").agg(F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


@query(f"""WITH {_PRED}, q AS (SELECT p.*, ms // 86400000 AS day FROM p JOIN e USING (event_id)), c AS (SELECT user_id, day, bool_or(event_type = 'error') AS e, bool_or(event_type = 'purchase') AS b, bool_or(event_type = 'signup') AS s FROM q GROUP BY ALL)
SELECT t AS template, count(*) AS n, round(avg(value), 6) AS mean FROM q JOIN c USING (user_id, day), (VALUES ('error', true, false, false), ('error,purchase', true, true, false), ('error,purchase,signup', true, true, true)) AS x(t, xe, xb, xs)
WHERE e = xe AND b = xb AND s = xs GROUP BY 1""")
def context_groups(spark, d):
    rows = events(spark, d).select("user_id", F.expr("ms div 86400000").alias("day"), "event_type", "value")
    of = ["error", "purchase", "signup"]
    contexts = rows.groupBy("user_id", "day").agg(F.collect_set("event_type").alias("c"))
    rows = rows.join(contexts, ["user_id", "day"])
    templates = [["error"], ["error", "purchase"], ["error", "purchase", "signup"]]
    named = F.array_compact(F.array(*(F.when(agg.exactly(F.col("c"), t, of), F.lit(",".join(t))) for t in templates)))
    return rows.select("value", F.explode(named).alias("template")).groupBy("template").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT sum(l_linenumber)::BIGINT AS lines, sum((l_returnflag = 'R')::INT)::BIGINT AS returned, sum((l_linestatus = 'O')::INT)::BIGINT AS open FROM lineitem")
def sum_counters(spark, d):
    flag = lambda c, v: F.sum((F.col(c) == v).cast("long"))
    return table(spark, d, "lineitem").agg(F.sum("l_linenumber").alias("lines"), flag("l_returnflag", "R").alias("returned"), flag("l_linestatus", "O").alias("open"))


@query(f"WITH {E} SELECT DISTINCT user_id, ms // 60000 + k * 30 AS beat FROM e, range(0, 3) AS r(k) WHERE event_type = 'purchase' AND k <= event_id % 3")
def distinct_rhythm(spark, d):
    rows = events(spark, d).where("event_type = 'purchase'").select("user_id", "ms", F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)).alias("k"))
    return rows.select("user_id", (F.expr("ms div 60000") + F.col("k") * 30).cast("long").alias("beat")).distinct()


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i AS i, b.i AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM v a JOIN v b USING (vec_id) WHERE a.i <= b.i GROUP BY ALL""")
def mean_cov(spark, d):
    _, _, cov = agg.moments(table(spark, d, "embeddings"), "embedding", 64)
    return spark.createDataFrame([(i, j, round(float(cov[i, j]), 6)) for i in range(64) for j in range(i, 64)], "i long, j long, cov double")


@query()
def frechet(spark, d):
    rows = table(spark, d, "embeddings")
    sides = [agg.moments(rows.where(c), "embedding", 64)[1:] for c in ("label < 5", "label >= 5")]
    return spark.createDataFrame([(round(agg.frechet(*sides), 6),)], "distance double")


@query("""WITH v AS (SELECT label < 5 AS low, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT low, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM v GROUP BY 1)
SELECT round((p.mx - q.mx) ^ 2 + (p.my - q.my) ^ 2 + p.a + p.c + q.a + q.c - 2 * sqrt(p.a * q.a + 2 * p.b * q.b + p.c * q.c + 2 * sqrt((p.a * p.c - p.b ^ 2) * (q.a * q.c - q.b ^ 2))), 6) AS distance FROM s p JOIN s q ON p.low AND NOT q.low""")
def frechet_plane(spark, d):
    """Of the first two numbers of the vectors, where the root's trace has a closed form."""
    rows = table(spark, d, "embeddings").select("label", F.slice("embedding", 1, 2).alias("v"))
    sides = [agg.moments(rows.where(c), "v", 2)[1:] for c in ("label < 5", "label >= 5")]
    return spark.createDataFrame([(round(agg.frechet(*sides), 6),)], "distance double")


@query("SELECT round(avg((l_extendedprice - l_quantity * 900) ^ 2), 2) AS mse, round(avg(abs(l_extendedprice - l_quantity * 900)), 4) AS mae FROM lineitem")
def mse_mae(spark, d):
    off = F.col("l_extendedprice") - F.col("l_quantity") * 900
    return table(spark, d, "lineitem").agg(F.round(F.avg(off * off), 2).alias("mse"), F.round(F.avg(F.abs(off)), 4).alias("mae"))


@query("SELECT user_id, round(count(*) FILTER (event_type = 'purchase') / nullif(count(*), 0), 6) AS hold_ratio, bool_or(event_type = 'error') AS any_error FROM events GROUP BY 1")
def hold_ratio_and_any(spark, d):
    hold = F.count_if(F.col("event_type") == "purchase") / F.nullif(F.count("*"), F.lit(0).cast("long"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(hold, 6).alias("hold_ratio"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


@query(f"""WITH {E}, c AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ms, event_id), false) AS changed FROM e)
SELECT user_id, round(count(*) FILTER (changed) / count(DISTINCT ms // 60000), 6) AS ratio FROM c GROUP BY 1""")
def change_ratio(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ms", "event_id"))
    rows = events(spark, d).select("user_id", "ms", F.coalesce(F.col("event_type") != before, F.lit(False)).alias("changed"))
    return rows.groupBy("user_id").agg(F.round(F.count_if("changed") / F.countDistinct(F.expr("ms div 60000")), 6).alias("ratio"))


@query("SELECT doc_id, round(n_chars / 44.1 * 1000, 6) AS length_ms FROM documents")
def song_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / F.lit(44.1).cast("double") * 1000, 6).alias("length_ms"))


@query(f"""WITH {E}, m AS (SELECT user_id, max(ms) AS stop FROM e GROUP BY 1),
p AS (SELECT user_id, ms, (event_id % 4) AS period, stop, row_number() OVER w AS k, lead(ms) OVER w AS nxt FROM e JOIN m USING (user_id) WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
s AS (SELECT user_id, period, sum(coalesce(nxt, stop) - CASE WHEN k = 1 THEN 0 ELSE ms END) AS len, max(ms) AS last FROM p GROUP BY ALL)
SELECT user_id, arg_max(period, len * 10000000000 + last) AS period FROM s WHERE len > 0 GROUP BY 1""")
def dominant_period(spark, d):
    rows = events(spark, d).select("user_id", "ms", "event_id", "event_type")
    points = rows.where("event_type = 'purchase'").select("user_id", "ms", (F.col("event_id") % 4).alias("period"))
    stops = rows.groupBy("user_id").agg(F.max("ms").alias("stop"))
    return agg.dominant_period(points.join(stops, "user_id"), "user_id", "ms", "period", "stop")


@query("WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_orderpriority, round(120 * (1 - (v - (SELECT min(v) FROM m)) / ((SELECT max(v) FROM m) - (SELECT min(v) FROM m))), 4) AS hue FROM m")
def colour_scale(spark, d):
    from cadence.functions.scalars import hue

    means = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    ends = means.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return means.join(F.broadcast(ends)).select("o_orderpriority", F.round(hue(F.col("v"), F.col("lo"), F.col("hi"), lower_is_better=True), 4).alias("hue"))


@query("""SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def log_latest_pivot(spark, d):
    return agg.latest(table(spark, d, "events"), "user_id", "event_type", "value", "event_id", ["click", "view"])


@query(f"""WITH {E}, g AS (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap FROM e) SELECT user_id, coalesce(sum(gap) FILTER (gap < 36000000), 0)::BIGINT AS total FROM g GROUP BY 1""")
def gap_sum(spark, d):
    return agg.gap_sum(events(spark, d), "user_id", "ms", 36_000_000)


@query(f"""WITH {E}, p AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings), q AS (SELECT vec_id, label, list_sum(a[label + 1:label + 3]) / list_sum(a) AS mass FROM p)
SELECT label, round(sum(-ln(greatest(mass, 1e-4))) / count(*), 6) AS loss FROM q GROUP BY 1""")
def leniency_band_loss(spark, d):
    absolute = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = table(spark, d, "embeddings").select("label", absolute.alias("a"))
    mass = total(F.slice("a", F.col("label") + 1, F.lit(3))) / total(F.col("a"))
    return rows.select("label", (-F.log(F.greatest(mass, F.lit(1e-4)))).alias("x")).groupBy("label").agg(F.round(F.sum("x") / F.count("*"), 6).alias("loss"))


@query("SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def median_interpolated(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.5).alias("median"))


@query("SELECT label, round(avg((sqrt((embedding[1]::DOUBLE) ^ 2 + (embedding[2]::DOUBLE) ^ 2) < 0.15)::INT), 6) AS hit_rate, count(*) AS n FROM embeddings GROUP BY 1")
def hit_rate(spark, d):
    far = F.hypot(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg((far < 0.15).cast("int")), 6).alias("hit_rate"), F.count("*").alias("n"))


@query(f"""WITH {E}, t AS (SELECT user_id, value FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10), w AS (SELECT user_id, sqrt(avg(value * value)) AS w FROM t GROUP BY 1)
SELECT user_id, round(w / (SELECT sum(w) FROM w), 8) AS weight FROM w""")
def importance_weights(spark, d):
    return agg.loss_weights(table(spark, d, "events"), "user_id", "value", "event_id").withColumn("weight", F.round("weight", 8))


