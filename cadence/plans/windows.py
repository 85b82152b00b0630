"""Window queries over events (per user) and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.scalars import hashed, sped, uniform
from cadence.operators import windows as win
from cadence.operators.ranking import with_position
from cadence.plans.joins import E, events
from cadence.plans.registry import query, table

_W = "(PARTITION BY user_id ORDER BY ms, event_id)"


def order():
    return win.ordered("user_id", "ms", "event_id")


def stream(spark, d):
    return events(spark, d).select("event_id", "user_id", "event_type", "value", "ms")


def numbered(spark, d):
    return stream(spark, d).withColumn("seq", F.row_number().over(order()) - 1)


_N = f"{E}, n AS (SELECT event_id, user_id, event_type, value, ms, row_number() OVER {_W} - 1 AS seq FROM e)"


@query(f"WITH {E} SELECT event_id, round(sqrt((value - coalesce(lag(value) OVER {_W}, 256)) ^ 2 + (ms % 384 - coalesce(lag(ms % 384) OVER {_W}, 192)) ^ 2), 6) AS distance FROM e")
def step_distance(spark, d):
    far = win.step_distance(F.col("value"), (F.col("ms") % 384).cast("double"), order())
    return stream(spark, d).select("event_id", F.round(far, 6).alias("distance"))


@query(f"WITH {E}, c AS (SELECT event_id, event_type, coalesce(lag(event_type) OVER {_W}, 'view') AS before FROM e) SELECT event_id, event_type FROM c WHERE event_type <> before")
def state_changes(spark, d):
    return win.changes(stream(spark, d), "event_type", order(), initial="view").select("event_id", "event_type")


@query(f"WITH {E} SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100) AS carried FROM e")
def carry_forward(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return stream(spark, d).select("event_id", win.carried(value, order(), 100.0).alias("carried"))


@query(f"""WITH {E}, p AS (SELECT event_id, user_id, ms // 3600000 AS hour, event_type = 'purchase' AS red, CASE WHEN event_type = 'purchase' THEN 100 + event_id % 400 ELSE -50 - event_id % 100 END::DOUBLE AS v FROM e WHERE event_type IN ('purchase', 'signup')),
b AS (SELECT *, coalesce(last_value(CASE WHEN red THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 300) AS beat, lead(hour) OVER (PARTITION BY user_id ORDER BY hour, event_id) AS nxt FROM p),
s AS (SELECT event_id, user_id, hour, CASE WHEN red THEN 1 ELSE -100 / v END * 300 / beat AS speed FROM b WHERE nxt IS NULL OR nxt > hour),
c AS (SELECT *, lag(speed) OVER (PARTITION BY user_id ORDER BY hour, event_id) AS before FROM s)
SELECT event_id, round(speed, 6) AS speed FROM c WHERE before IS NULL OR speed <> before""")
def normalized_speeds(spark, d):
    rows = stream(spark, d).where("event_type IN ('purchase', 'signup')").withColumn("red", F.col("event_type") == "purchase")
    value = F.when(F.col("red"), 100 + F.col("event_id") % 400).otherwise(-50 - F.col("event_id") % 100).cast("double")
    rows = rows.select("event_id", "user_id", F.expr("ms div 3600000").alias("hour"), "red", value.alias("v"), F.lit(300.0).alias("typical"))
    return win.normalized_speeds(rows, "user_id", "hour", "event_id", "red", "v", "typical").select("event_id", F.round("speed", 6).alias("speed"))


@query(f"""WITH {E}, p AS (SELECT user_id, ms, 300000 + (event_id % 7) * 60000 AS period, 3 + event_id % 2 AS meter FROM e WHERE event_type = 'purchase'),
s AS (SELECT *, coalesce(lead(ms) OVER (PARTITION BY user_id ORDER BY ms) - 10, 2600000000) AS stop FROM p)
SELECT user_id, ms + k * period AS time, k::INT AS beat, CASE WHEN k % meter = 0 THEN 'measure' ELSE 'beat' END AS kind FROM s, unnest(range(0, (stop - ms) // period + 1)) AS r(k) WHERE stop >= ms""")
def beat_grid(spark, d):
    rows = stream(spark, d).where("event_type = 'purchase'").select(
        "user_id", "ms", (300_000 + (F.col("event_id") % 7) * 60_000).alias("period"), (3 + F.col("event_id") % 2).alias("meter"), F.lit(2_600_000_000).alias("stop")
    )
    return win.beat_grid(rows, "user_id", "ms", "period", "meter", "stop")


@query(f"""WITH {_N} SELECT a.event_id, string_agg(b.event_type, ',' ORDER BY b.seq) FILTER (b.seq < a.seq - 1) AS history, max(b.event_type) FILTER (b.seq = a.seq - 1) AS label
FROM n a JOIN n b ON a.user_id = b.user_id AND b.seq BETWEEN a.seq - 5 AND a.seq - 1 WHERE a.event_type = 'purchase' AND a.seq > 4 GROUP BY 1""")
def history_windows(spark, d):
    rows = win.histories(stream(spark, d), order(), "event_type", 4, F.col("event_type") == "purchase")
    return rows.select("event_id", F.array_join("history", ",").alias("history"), "label")


@query(f"""WITH {_N}, s AS (SELECT user_id, max(seq) + 1 AS size FROM n GROUP BY 1), x AS (SELECT user_id, size, unnest(range(0, (size - 16) // 8 + 1)) AS win FROM s WHERE size >= 16)
SELECT x.user_id, win AS window_id, count(*) AS n, round(sum(value), 4) AS total FROM x JOIN n ON n.user_id = x.user_id AND seq BETWEEN win * 8 AND win * 8 + 15 GROUP BY ALL""")
def sliding_windows(spark, d):
    rows = win.sliding(numbered(spark, d), "user_id", "seq", 16, 8)
    return rows.groupBy("user_id", F.col("window").alias("window_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH s AS (SELECT doc_id, greatest(ceil((n_chars - 1024) / 512.0), 0)::INT + 1 AS n FROM documents)
SELECT doc_id, w::INT AS window_id, (w * 512)::INT AS start FROM s, unnest(range(0, n)) AS r(w) WHERE w * 512 >= 512 AND w * 512 < 4096""")
def padded_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.inline(win.padded_windows(F.col("n_chars"), 1024, 512)))
    return rows.where("start >= 512 AND start < 4096").select("doc_id", F.col("window").alias("window_id"), "start")


@query(f"""WITH {_N}, t AS (SELECT user_id, seq // 10 AS w, count(*) AS n, min(ms) AS first_ms FROM n GROUP BY ALL)
SELECT user_id, w AS window_id, n, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY w), 0) AS n_before, first_ms FROM t""")
def tumbling_windows(spark, d):
    rows = win.tumbling(numbered(spark, d), "seq", 10).groupBy("user_id", F.col("window").alias("window_id"))
    rows = rows.agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"))
    before = F.coalesce(F.lag("n").over(Window.partitionBy("user_id").orderBy("window_id")), F.lit(0))
    return rows.withColumn("n_before", before)


@query(f"WITH {E} SELECT event_id, round(sum(value) OVER {_W}, 4) AS length FROM e")
def path_length(spark, d):
    return stream(spark, d).select("event_id", F.round(win.path_length(F.col("value"), order()), 4).alias("length"))


@query(f"""WITH {E}, c AS (SELECT user_id, ms // 3600000 AS h, count(*)::DOUBLE AS n FROM e WHERE event_type = 'click' GROUP BY ALL), k AS (SELECT i, exp(-0.5 * (i / 2.0) ^ 2) AS w FROM unnest(range(-8, 9)) AS r(i)),
g AS (SELECT i, w / (SELECT sum(w) FROM k) AS w FROM k) SELECT user_id, h + i AS hour, round(sum(n * w), 6) AS density FROM c, g GROUP BY ALL""")
def gaussian_smoothing(spark, d):
    counts = stream(spark, d).where("event_type = 'click'").groupBy("user_id", F.expr("ms div 3600000").alias("hour")).agg(F.count("*").cast("double").alias("density"))
    return win.smoothed(counts, "user_id", "hour", "density", 2.0).withColumn("density", F.round("density", 6))


@query(f"""WITH {E}, c AS (SELECT user_id, (ms // 3600000)::INT AS h, count(*)::DOUBLE AS n FROM e WHERE event_type = 'click' GROUP BY ALL), k AS (SELECT i::INT AS i, exp(-0.5 * (i / 2.0) ^ 2) AS w FROM unnest(range(-8, 9)) AS r(i)),
g AS (SELECT i, w / (SELECT sum(w) FROM k) AS w FROM k), p AS (SELECT user_id, n * w AS x, CASE WHEN h + i < 0 THEN -1 - (h + i) WHEN h + i >= 720 THEN 1439 - (h + i) ELSE h + i END AS hour FROM c, g)
SELECT user_id, hour, round(sum(x), 6) AS density FROM p GROUP BY ALL""")
def gaussian_reflected(spark, d):
    """Smoothing of a month of 720 hours, mirrored at both ends."""
    hour = F.expr("ms div 3600000").cast("int").alias("hour")
    counts = stream(spark, d).where("event_type = 'click'").groupBy("user_id", hour).agg(F.count("*").cast("double").alias("density")).withColumn("size", F.lit(720))
    return win.smoothed(counts, "user_id", "hour", "density", 2.0, size="size").withColumn("density", F.round("density", 6))


@query(f"""WITH {_N}, m AS (SELECT user_id, seq, event_type, value, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 WHEN 'click' THEN 1 END AS mark FROM n),
o AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN trunc(value * 100)::BIGINT END IGNORE NULLS) OVER p, 0) AS own, coalesce(first_value(mark IGNORE NULLS) OVER f, 0) AS open, count(*) FILTER (mark = 0) OVER f AS run, count(*) FILTER (event_type = 'purchase') OVER p AS zone
  FROM m WINDOW p AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, coalesce(first_value(CASE WHEN open = 0 THEN own END IGNORE NULLS) OVER f, 100000) AS origin, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN own END IGNORE NULLS) OVER p, 0) AS goal,
  count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, run ORDER BY seq DESC) AS i, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id, zone ORDER BY seq) AS c
  FROM o WINDOW p AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, CASE WHEN event_type = 'click' THEN list_reduce(list_prepend(origin::DOUBLE, range(1, i + 1)::DOUBLE[]), lambda now, k: trunc((now - goal) / (c + i - k + 1) * (c + i - k) + goal))::BIGINT END AS moved FROM r)
SELECT user_id, seq, CASE WHEN open = 1 THEN first_value(moved IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE own END AS time_ms FROM x""")
def timed_events(spark, d):
    """Times of all events: purchases as time shifts, signups as timed kinds, clicks as control points."""
    kind = F.when(F.col("event_type") == "purchase", "time_shift").otherwise(F.col("event_type"))
    rows = numbered(spark, d).select("user_id", "seq", kind.alias("kind"), F.floor(F.col("value") * 100).alias("value"))
    return win.timed_events(rows, "user_id", "seq", "kind", "value", ["click"], ["signup"], F.lit(100_000)).select("user_id", "seq", "time_ms")


@query(f"""WITH {E}, c AS (SELECT event_id, floor(value / 50)::INT AS x, floor(value / 50)::INT IS DISTINCT FROM lag(floor(value / 50)::INT) OVER {_W} AS kept FROM e) SELECT event_id, x FROM c WHERE kept""")
def without_repeats(spark, d):
    """A path's points without those that repeat the one before."""
    rows = stream(spark, d).withColumn("x", F.floor(F.col("value") / 50).cast("int"))
    return win.changes(rows, "x", order()).select("event_id", "x")


@query(f"""WITH {_N}, t AS (SELECT user_id, seq, CASE WHEN event_type IN ('click', 'view') THEN ms END AS t FROM n),
b AS (SELECT *, coalesce(last_value(t IGNORE NULLS) OVER p, 0) AS lo, first_value(t IGNORE NULLS) OVER f AS hi, count(t) OVER p AS g FROM t
  WINDOW p AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, sum((t IS NULL)::INT) OVER (PARTITION BY user_id, g) AS k, sum((t IS NULL)::INT) OVER (PARTITION BY user_id, g ORDER BY seq) AS i FROM b)
SELECT user_id, seq, coalesce(t, trunc(lo + (coalesce(hi, lo) - lo) * i / (k + 1)))::BIGINT AS ms FROM c""")
def interp_gaps(spark, d):
    timed = F.when(F.col("event_type").isin("click", "view"), F.col("ms"))
    rows = numbered(spark, d).select("seq", "user_id", timed.alias("ms"))
    return win.gap_filled(rows, "user_id", "ms", "seq")


@query(f"""WITH {_N}, g AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS total FROM n)
SELECT user_id, greatest(least(raw, total - 1), 0)::BIGINT AS grp, count(*) AS n, string_agg(CASE WHEN event_type = 'click' THEN event_id::VARCHAR END, ',' ORDER BY seq) AS clicks FROM g GROUP BY ALL""")
def boundary_groups(spark, d):
    rows = win.boundary_groups(numbered(spark, d), "user_id", "seq", F.col("event_type") == "purchase", heads_first=False)
    clicks = F.sort_array(F.collect_list(F.when(F.col("event_type") == "click", F.struct("seq", "event_id"))))
    rows = rows.groupBy("user_id", F.col("group").alias("grp")).agg(F.count("*").alias("n"), clicks.alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["event_id"].cast("string")), ",")
    return rows.select("user_id", "grp", "n", F.when(F.size("c") > 0, joined).alias("clicks"))


@query(f"""WITH {_N}, g AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY seq) - 1 AS raw, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id) AS total FROM n)
SELECT user_id, greatest(least(raw, total - 1), 0)::BIGINT AS grp, count(*) AS n FROM g GROUP BY ALL""")
def boundary_groups_heads_first(spark, d):
    rows = win.boundary_groups(numbered(spark, d), "user_id", "seq", F.col("event_type") == "purchase", heads_first=True)
    return rows.groupBy("user_id", F.col("group").alias("grp")).agg(F.count("*").alias("n"))


@query(f"""WITH {E}, p AS (SELECT user_id, ms AS a, coalesce(lead(ms) OVER (PARTITION BY user_id ORDER BY ms), 9000000000) AS b, 1000.0 + event_id % 9 * 100 AS period FROM e WHERE event_type = 'purchase'),
s AS (SELECT event_id, user_id, ms AS x, ms + 90000000 AS y FROM e WHERE event_type = 'signup')
SELECT event_id, round(coalesce(sum(greatest(least(y, b) - greatest(x, a), 0) / period), 0), 6) AS beats FROM s LEFT JOIN p ON s.user_id = p.user_id AND a < y AND b > x GROUP BY 1""")
def beats_between(spark, d):
    rows = stream(spark, d)
    points = rows.where("event_type = 'purchase'").select("user_id", "ms", (1000.0 + F.col("event_id") % 9 * 100).alias("period"))
    spans = rows.where("event_type = 'signup'").select("event_id", "user_id", F.col("ms").alias("x"), (F.col("ms") + 90_000_000).alias("y"))
    return win.beats_between(points, "user_id", "ms", "period", spans, "x", "y").select("event_id", F.round("beats", 6).alias("beats"))


@query(f"WITH {E} SELECT event_id, coalesce(least(greatest(round_even((ms - lag(ms) OVER {_W} - 1000) * 0.00001, 0)::BIGINT, 0), 500), -1)::INT AS step FROM e")
def delta_steps(spark, d):
    step = win.delta_step(F.col("ms"), order(), 1000, 0.00001, 500)
    return stream(spark, d).select("event_id", F.coalesce(step, F.lit(-1)).alias("step"))


@query(f"WITH {E}, g AS (SELECT event_id, (ms - lag(ms) OVER {_W}) // 1000000 AS period FROM e WHERE event_type = 'click') SELECT event_id, period FROM g WHERE period > 20 AND period < 100")
def beat_periods(spark, d):
    rows = stream(spark, d).where("event_type = 'click'").withColumn("_d", F.col("ms") - F.lag("ms").over(order()))
    return rows.select("event_id", F.expr("_d div 1000000").alias("period")).where("period > 20 AND period < 100")


@query(f"""WITH {E}, v AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS k FROM e), m AS (SELECT median(value) AS m FROM e)
SELECT event_id, round(coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), m), 6) AS filled FROM v, m""")
def nearest_fill(spark, d):
    rows = stream(spark, d)
    rows = rows.join(F.broadcast(rows.agg(F.percentile("value", 0.5).alias("m"))))
    known = F.when(F.col("event_type") == "purchase", F.col("value"))
    return rows.select("event_id", F.round(win.filled_forward_back(known, order(), F.col("m")), 6).alias("filled"))


@query("""WITH t AS (SELECT event_id, value + 1 AS v FROM events), a AS (SELECT event_id, v / ceil(v / (120 * 1.5)) AS x FROM t) SELECT event_id, round(x * ceil((120 / 1.5) / x), 6) AS tempo FROM a""")
def octave_normalized(spark, d):
    tempo = win.octave_normalized(F.col("value") + 1, F.lit(120.0))
    return table(spark, d, "events").select("event_id", F.round(tempo, 6).alias("tempo"))


@query(f"WITH {_N} SELECT a.user_id, a.seq AS i, b.seq AS j FROM n a JOIN n b ON a.user_id = b.user_id AND abs(a.seq - b.seq) <= 2")
def banded_neighbourhood(spark, d):
    return win.neighbourhood(numbered(spark, d).select("user_id", F.col("seq").cast("long").alias("seq")), "user_id", "seq", 2)


@query("SELECT doc_id, s AS start, least(s + 1000, n_chars) AS stop FROM documents, unnest(range(0, n_chars - 200, 800)) AS r(s) WHERE n_chars > 200")
def part_schedule(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(win.part_schedule(F.col("n_chars"), 1000, 100)).alias("p"))
    return rows.select("doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("stop"))


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS round FROM orders) SELECT o_orderkey, o_orderpriority, round FROM r")
def interleave(spark, d):
    rows = win.interleaved(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    return rows.orderBy("round", "o_orderpriority")


@query(f"WITH {E}, h AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e) SELECT event_id, user_id FROM h WHERE high IS NULL OR value >= high")
def monotonic_times(spark, d):
    return win.monotonic(stream(spark, d), "user_id", "event_id", "value").select("event_id", "user_id")


@query(f"""WITH q AS (SELECT event_type, event_id, 1 + event_id % 5 AS work, sum(1 + event_id % 5) OVER (PARTITION BY event_type ORDER BY event_id) AS stop FROM events), b AS (SELECT *, stop - work AS start FROM q)
SELECT event_type, k AS batch, event_id, (least(stop, (k + 1) * 16) - greatest(start, k * 16))::BIGINT AS units FROM b, unnest(range((start // 16)::BIGINT, ((stop - 1) // 16)::BIGINT + 1)) AS r(k)""")
def packed_batches(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", (1 + F.col("event_id") % 5).alias("work"))
    return win.packed_batches(rows, "event_type", "event_id", "work", 16)


@query(f"WITH {E} SELECT event_id, trunc(ms / 1.5)::BIGINT AS ms FROM e")
def speed_events(spark, d):
    return stream(spark, d).select("event_id", sped(F.col("ms"), F.lit(1.5)).alias("ms"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('11:' || o_orderkey), o_orderkey) - 1 AS place FROM orders")
def hashed_shuffle(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", hashed(11, "o_orderkey").alias("h"))
    return with_position(rows, ["h", "o_orderkey"], "place").drop("h")


@query("SELECT o_orderkey FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark, d):
    return table(spark, d, "orders").select("o_orderkey").orderBy(hashed(3, "o_orderkey"), "o_orderkey").limit(100)


@query("""WITH c AS (SELECT *, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi,
  sum(l_quantity) OVER (PARTITION BY l_orderkey) * ('0x' || substr(md5('5:' || l_orderkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS point FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM c WHERE point >= hi - l_quantity AND point < hi""")
def weighted_choice(spark, d):
    """One line per order with probability by quantity: the line that holds a hashed point of the cumulative weight.

    Line numbers repeat within an order, so further columns make the order total.
    """
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*tie)
    rows = table(spark, d, "lineitem").select("l_orderkey", *tie)
    rows = rows.withColumn("hi", F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("l_quantity"))
    rows = rows.withColumn("total", F.sum("l_quantity").over(Window.partitionBy("l_orderkey")))
    point = F.col("total") * uniform(5, "l_orderkey")
    return rows.where((point >= F.col("lo")) & (point < F.col("hi"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def class_counts(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def ordered_top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(f"WITH {E}, p AS (SELECT user_id, event_id, ms // 3600000 AS hour, event_type = 'purchase' AS red FROM e WHERE event_type IN ('purchase', 'signup')) SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY hour, red DESC, event_id) AS place FROM p")
def red_before_green(spark, d):
    rows = stream(spark, d).where("event_type IN ('purchase', 'signup')").withColumn("hour", F.expr("ms div 3600000"))
    order = Window.partitionBy("user_id").orderBy("hour", (F.col("event_type") == "purchase").desc(), "event_id")
    return rows.select("event_id", F.row_number().over(order).alias("place"))


@query("""WITH c AS (SELECT user_id, ts::DATE::VARCHAR AS day, list(DISTINCT event_type) AS has FROM events GROUP BY ALL), t(k, need) AS (VALUES (0, ['view']), (1, ['error', 'view']), (2, ['click', 'purchase', 'view']))
SELECT user_id, day, arg_max(k, len(need) * 10 - k) AS template FROM c, t WHERE list_has_all(has, need) GROUP BY ALL""")
def best_template(spark, d):
    has = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.collect_set("event_type").alias("has"))
    needs = [["view"], ["error", "view"], ["click", "purchase", "view"]]
    fits = [F.when(F.forall(F.array(*map(F.lit, n)), lambda x: F.array_contains("has", x)), F.struct(F.lit(len(n)).alias("n"), F.lit(-k).alias("k"))) for k, n in enumerate(needs)]
    best = F.array_max(F.array_compact(F.array(*fits)))
    return has.select("user_id", "day", best.alias("b")).where("b IS NOT NULL").select("user_id", "day", (-F.col("b.k")).alias("template"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, event_type FROM events WHERE value > 50")
def union_all_events(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    return rows.where("event_type = 'click'").unionByName(rows.where("value > 50")).drop("value")


@query("""WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS all_, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_sort(list_filter(all_, lambda x: NOT coalesce(list_contains(done, x), false))), ',') AS left_over FROM s""")
def set_difference(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderpriority").alias("all"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("done")
    )
    return rows.select("o_custkey", F.array_join(F.sort_array(F.array_except("all", "done")), ",").alias("left_over"))


@query(f"""WITH {E}, t AS (SELECT user_id, ms // 86400000 AS win, row_number() OVER (PARTITION BY user_id, ms // 86400000 ORDER BY ms, event_id) AS seq, CASE WHEN event_type = 'purchase' THEN 'time_shift' WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'eos' ELSE event_type END AS kind,
  CASE WHEN event_type = 'purchase' THEN ms % 86400000 // 10000 ELSE event_id % 50 END AS value, ms // 86400000 = max(ms // 86400000) OVER (PARTITION BY user_id) AS final FROM e),
f AS (SELECT user_id, win, max(seq) FILTER (kind <> 'eos') AS seq, arg_max(kind, seq) FILTER (kind <> 'eos') AS kind, arg_max(value, seq) FILTER (kind <> 'eos') AS value, min(seq) FILTER (kind = 'eos') AS eos FROM t GROUP BY ALL),
k AS (SELECT t.* FROM t JOIN f USING (user_id, win) WHERE t.kind <> 'eos' AND t.seq < coalesce(eos, 1e9) AND NOT (t.seq = f.seq AND NOT final AND f.kind = 'time_shift' AND f.value >= 6048)),
v AS (SELECT user_id, win, seq, kind, final, CASE WHEN kind = 'time_shift' THEN win * 60000 + value * 10 ELSE value END AS value FROM k),
x AS (SELECT *, last_value(CASE WHEN kind = 'time_shift' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, win ORDER BY seq) AS tt FROM v),
y AS (SELECT *, max(CASE WHEN tt IS NULL OR tt <= win * 60000 + 60480 THEN seq END) OVER (PARTITION BY user_id, win) AS kept FROM x)
SELECT user_id, win AS "window", seq, kind, value, coalesce(last_value(tt IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY win, seq), 0) AS time_ms FROM y WHERE final OR seq <= kept""")
def trimmed_windows(spark, d):
    """Users' days as generated windows of 86.4 s, 60 s apart: purchases are time shifts, some errors end a window."""
    kind = F.when(F.col("event_type") == "purchase", "time_shift").when((F.col("event_type") == "error") & (F.col("event_id") % 11 == 0), "eos").otherwise(F.col("event_type"))
    value = F.when(F.col("event_type") == "purchase", F.expr("ms % 86400000 div 10000")).otherwise(F.col("event_id") % 50)
    rows = stream(spark, d).withColumn("window", F.expr("ms div 86400000"))
    rows = rows.select("user_id", "window", F.row_number().over(Window.partitionBy("user_id", "window").orderBy("ms", "event_id")).alias("seq"), kind.alias("kind"), value.alias("value"))
    return win.trimmed_windows(rows, "user_id", 10, 60_000, 86_400, lookback=0.1, lookahead=0.3)
