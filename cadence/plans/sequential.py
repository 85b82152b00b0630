"""Queries whose operators walk ordered groups; tests hold them against small worked cases."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions import curves
from cadence.operators import beats as beat
from cadence.operators import sequential as seq
from cadence.plans.joins import E, events
from cadence.plans.registry import query, table


def _points(spark, d):
    rows = events(spark, d).where("event_type IN ('purchase', 'signup')")
    red = F.col("event_type") == "purchase"
    return rows.select(
        F.col("user_id").alias("track"), F.expr("ms div 1000").alias("offset_ms"), F.when(red, F.lit(300.0)).otherwise(F.lit(-100.0)).alias("value"),
        F.lit(4).alias("meter"), F.lit(2).alias("sample_type"), F.lit(0).alias("sample_set"), F.lit(100).alias("volume"), F.lit(False).alias("kiai"), red.alias("is_red"),
    )


@query()
def timing_edits(spark, d):
    rows = events(spark, d).where("event_type = 'error'")
    no = F.lit(False)
    changes = rows.select(
        F.col("user_id").alias("track"), F.expr("ms div 1000").alias("offset_ms"), F.col("event_id").alias("seq"), F.lit(-50.0).alias("value"), F.lit(3).alias("meter"),
        F.lit(1).alias("sample_type"), F.lit(0).alias("sample_set"), (F.col("event_id") % 100).cast("int").alias("volume"), F.lit(True).alias("kiai"),
        (F.col("event_id") % 3 == 0).alias("is_red"), (F.col("event_id") % 2 == 0).alias("set_value"), no.alias("set_meter"), no.alias("set_sample_type"),
        no.alias("set_sample_set"), F.lit(True).alias("set_volume"), no.alias("set_kiai"),
    )
    return seq.timing_edits(_points(spark, d), changes)


@query(f"""WITH RECURSIVE {E}, n AS (SELECT user_id AS chart, event_id AS seq, ms // 36000 AS t, round(value, 0) AS x, (event_id % 7)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ms // 36000, event_id) AS k FROM e),
r(chart, k, ts, xs, ys) AS (
  SELECT chart, k, [t], [x], [y] FROM n WHERE k = 1
  UNION ALL SELECT chart, k, list_append(ts, t), list_append(xs, CASE WHEN j IS NULL THEN x ELSE xs[j] END), list_append(ys, CASE WHEN j IS NULL THEN y ELSE ys[j] END)
  FROM (SELECT n.*, ts, xs, ys, list_filter(range(1, len(ts) + 1), lambda i: ts[i] >= n.t - 1000 AND sqrt((xs[i] - n.x) ^ 2 + (ys[i] - n.y) ^ 2) < 3.8)[1] AS j FROM r JOIN n ON n.chart = r.chart AND n.k = r.k + 1))
SELECT r.chart, n.seq, n.t AS time_ms, xs[-1] AS x, ys[-1] AS y FROM r JOIN n ON n.chart = r.chart AND n.k = r.k""")
def proximity_snap(spark, d):
    rows = events(spark, d).select(
        F.col("user_id").alias("chart"), F.col("event_id").alias("seq"), F.expr("ms div 36000").alias("time_ms"), F.round("value", 0).alias("x"), (F.col("event_id") % 7).cast("double").alias("y")
    )
    return seq.snapped_overlaps(rows)


def _signal(spark, d):
    """Users' hourly sums, added up in the events' order: equal sums may differ by their last bit, which decides which sample is lower."""
    rows = events(spark, d).where("event_type IN ('click', 'view')")
    rows = rows.select(F.col("user_id").alias("track"), F.expr("ms div 3600000").alias("place"), "event_id", "value")
    so_far = F.sum("value").over(Window.partitionBy("track", "place").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("value", so_far).groupBy("track", "place").agg(F.max_by("value", "event_id").alias("value"))


def _rounded(name):
    """To six places as in SQL, from the product: just below a half in binary counts as the half."""
    return (F.round(F.col(name) * 1e6) / 1e6).alias(name)


_PEAKS = f"""WITH RECURSIVE {E}, h AS (SELECT user_id AS track, ms // 3600000 AS place, sum(value) AS v FROM e WHERE event_type IN ('click', 'view') GROUP BY ALL),
d AS (SELECT track, place, coalesce(v, 0) AS v FROM (SELECT track, unnest(range(0, max(place) + 2)) AS place FROM h GROUP BY track) LEFT JOIN h USING (track, place)),
c AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY v DESC, place) AS k FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM d WINDOW w AS (PARTITION BY track ORDER BY place)) WHERE v > a AND v >= b),
g(track, k, kept) AS (SELECT track, k, [place] FROM c WHERE k = 1
  UNION ALL SELECT c.track, c.k, CASE WHEN len(list_filter(kept, lambda q: abs(q - c.place) < 3)) = 0 THEN list_append(kept, c.place) ELSE kept END FROM g JOIN c ON c.track = g.track AND c.k = g.k + 1),
p AS (SELECT c.track, c.place, c.v FROM c JOIN (SELECT track, arg_max(kept, k) AS kept FROM g GROUP BY 1) AS f ON f.track = c.track AND list_contains(kept, c.place)),
s AS (SELECT p.track, p.place, p.v, max(d.place) FILTER (d.v > p.v AND d.place < p.place) AS lo, min(d.place) FILTER (d.v > p.v AND d.place > p.place) AS hi FROM p JOIN d ON d.track = p.track AND d.place BETWEEN p.place - 12 AND p.place + 12 GROUP BY ALL),
m AS (SELECT s.track, s.place, s.v, min(d.v) FILTER (d.place < s.place) AS a, min(d.v) FILTER (d.place > s.place) AS b FROM s JOIN d ON d.track = s.track AND d.place BETWEEN s.place - 12 AND s.place + 12 AND d.place > coalesce(lo, -1) AND d.place < coalesce(hi, 1e9) GROUP BY ALL)
"""


@query(f"{_PEAKS} SELECT track, place, round(v - greatest(a, b), 6) AS prominence FROM m WHERE v - greatest(a, b) >= 1")
def signal_peaks(spark, d):
    return beat.find_peaks(_signal(spark, d), distance=3, prominence=1.0, reach=12).select("track", "place", _rounded("prominence"))


@query(f"""{_PEAKS}, x AS (
  SELECT m.track, m.place, m.v, greatest(a, b) AS h, max(d.place) FILTER (d.place < m.place AND d.v <= greatest(a, b)) AS l, min(d.place) FILTER (d.place > m.place AND d.v <= greatest(a, b)) AS r
  FROM m JOIN d ON d.track = m.track AND d.place BETWEEN m.place - 12 AND m.place + 12 GROUP BY ALL
), y AS (
  SELECT x.*, r - (h - r0.v) / (r1.v - r0.v) - l - (h - l0.v) / (l1.v - l0.v) AS width FROM x JOIN d l0 ON l0.track = x.track AND l0.place = l JOIN d l1 ON l1.track = x.track AND l1.place = l + 1
  JOIN d r0 ON r0.track = x.track AND r0.place = r JOIN d r1 ON r1.track = x.track AND r1.place = r - 1
) SELECT track, place, round(v - h, 6) AS prominence, round(width, 6) AS width FROM y WHERE v - h >= 1 AND width >= 3""")
def wide_peaks(spark, d):
    """Peaks of users' hourly activity at least three hours wide at their base."""
    found = beat.find_peaks(_signal(spark, d), distance=3, prominence=1.0, reach=12, width=3.0)
    return found.select("track", "place", _rounded("prominence"), _rounded("width"))


@query()
def beat_walk(spark, d):
    peaks = beat.find_peaks(_signal(spark, d), distance=3, prominence=1.0, reach=12)
    peaks = peaks.select("track", "place", "prominence", F.lit(12.0).alias("period_ms"), F.lit(True).alias("sure"), F.lit(720.0).alias("length_ms"))
    return beat.beat_walk(peaks, near=0.05, doubtful=0.2, margin=4)


@query(f"""WITH RECURSIVE {E}, n AS (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS i, value AS score, event_type = 'purchase' AS red, count(*) OVER (PARTITION BY user_id) AS n FROM e),
h AS (SELECT track, bool_or(red AND i = 1) AS h2, bool_or(red AND i IN (1, 2)) AS h3, bool_or(red AND i = n - 1) AS b2, bool_or(red AND i >= n - 2) AS b3 FROM n GROUP BY 1),
q AS (SELECT a.track, a.i, k, avg(b.score) FILTER (NOT CASE j WHEN 2 THEN h2 WHEN 3 THEN h3 WHEN -2 THEN b2 WHEN -3 THEN b3 ELSE false END) AS m
  FROM n a JOIN h USING (track), range(4) AS x(k), range(-3, 4) AS y(j) LEFT JOIN n b ON b.track = a.track AND b.i = a.i + 4 * j + k GROUP BY ALL),
o AS (SELECT track, i, k AS best FROM q QUALIFY row_number() OVER (PARTITION BY track, i ORDER BY coalesce(m, 0) DESC, k) = 1),
v AS (SELECT * FROM n JOIN o USING (track, i)),
f(track, i, wait, hit) AS (
  SELECT track, i, CASE WHEN red THEN 0 WHEN best = 0 THEN 3 ELSE -best END::INT, NOT red AND best = 0 FROM v WHERE i = 0
  UNION ALL SELECT v.track, v.i, CASE WHEN f.wait > 0 THEN f.wait - 1 WHEN f.wait = -1 THEN CASE WHEN red THEN 0 ELSE 3 END WHEN f.wait < -1 THEN f.wait + 1 WHEN red THEN 0 WHEN best = 0 THEN 3 ELSE -best END::INT,
    CASE WHEN f.wait > 0 THEN false WHEN f.wait < 0 THEN f.wait = -1 AND NOT red ELSE NOT red AND best = 0 END FROM f JOIN v ON v.track = f.track AND v.i = f.i + 1)
SELECT track, i AS seq, hit AS measure FROM f""")
def measure_votes(spark, d):
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    rows = events(spark, d).select(F.col("user_id").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("is_red"))
    return seq.measure_votes(rows, 4)


@query()
def tempo_sections(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("track"), F.expr("ms div 10000").alias("time_ms"), (F.col("event_type") == "signup").alias("is_red"))
    return seq.tempo_sections(rows).withColumn("ms_per_beat", F.round("ms_per_beat", 6))


@query()
def inferred_red_points(spark, d):
    """Red points of users' events as beat markers: purchases as measures, signups as timing points."""
    kind = F.when(F.col("event_type") == "purchase", "measure").when(F.col("event_type") == "signup", "timing_point").otherwise("beat")
    rows = events(spark, d).select(F.col("user_id").alias("track"), F.expr("ms div 10000").alias("time_ms"), kind.alias("kind"))
    return seq.red_points(rows).withColumn("ms_per_beat", F.round("ms_per_beat", 6))


@query(f"WITH {E} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM e WHERE event_type = 'purchase'")
def peaks_by_prominence(spark, d):
    """Each track's peaks (purchases) in the order in which walks start from them: most prominent first."""
    rows = events(spark, d).where("event_type = 'purchase'")
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("place"))


@query("""WITH p AS (SELECT vec_id, k, sqrt((embedding[k + 1]::DOUBLE - embedding[k]::DOUBLE) ^ 2 + (embedding[k + 9]::DOUBLE - embedding[k + 8]::DOUBLE) ^ 2) AS step FROM embeddings, range(1, 8) AS r(k)),
c AS (SELECT vec_id, k, sum(step) OVER (PARTITION BY vec_id ORDER BY k) AS along FROM p)
SELECT vec_id, round(max(along), 6) AS length, round(max(along) FILTER (k = 3), 6) AS middle FROM c GROUP BY 1""")
def line_lengths(spark, d):
    """Lengths along paths of eight points: of the whole and up to the fourth point."""
    x, y = F.slice("embedding", 1, 8).cast("array<double>"), F.slice("embedding", 9, 8).cast("array<double>")
    along = curves.cumulative_length(F.lit("L"), x, y)
    rows = table(spark, d, "embeddings").select("vec_id", along.alias("a"))
    return rows.select("vec_id", F.round(F.element_at("a", -1), 6).alias("length"), F.round(F.get("a", F.lit(3)), 6).alias("middle"))


@query("""WITH q AS (SELECT vec_id, vec_id % 3 AS kind, list_transform(range(4), lambda k: {'x': embedding[k + 1]::DOUBLE, 'y': embedding[k + 5]::DOUBLE}) AS p FROM embeddings),
b AS (SELECT *, greatest(1, ceil(sqrt(0.75::DOUBLE * greatest(sqrt((p[1].x - 2 * p[2].x + p[3].x) ^ 2 + (p[1].y - 2 * p[2].y + p[3].y) ^ 2), sqrt((p[2].x - 2 * p[3].x + p[4].x) ^ 2 + (p[2].y - 2 * p[3].y + p[4].y) ^ 2)) / 0.1::DOUBLE)))::INT AS steps FROM q WHERE kind = 0),
c AS (SELECT vec_id, s, p[greatest(s, 1)] AS a, p[s + 1] AS b, p[s + 2] AS c, CASE WHEN s < 2 THEN p[s + 3] ELSE {'x': 2 * p[4].x - p[3].x, 'y': 2 * p[4].y - p[3].y} END AS d FROM q, range(3) AS r(s) WHERE kind = 1),
w AS (
  SELECT vec_id, i, (1 - i / steps) ^ 3 * p[1].x + 3 * (1 - i / steps) ^ 2 * (i / steps) * p[2].x + 3 * (1 - i / steps) * (i / steps) ^ 2 * p[3].x + (i / steps) ^ 3 * p[4].x AS x,
    (1 - i / steps) ^ 3 * p[1].y + 3 * (1 - i / steps) ^ 2 * (i / steps) * p[2].y + 3 * (1 - i / steps) * (i / steps) ^ 2 * p[3].y + (i / steps) ^ 3 * p[4].y AS y FROM b, unnest(range(0, steps + 1)) AS r(i)
  UNION ALL SELECT vec_id, s * 50 + i, 0.5::DOUBLE * (2 * b.x + (c.x - a.x) * (i / 50) + (2 * a.x - 5 * b.x + 4 * c.x - d.x) * (i / 50) ^ 2 + (3 * b.x - a.x - 3 * c.x + d.x) * (i / 50) ^ 3),
    0.5::DOUBLE * (2 * b.y + (c.y - a.y) * (i / 50) + (2 * a.y - 5 * b.y + 4 * c.y - d.y) * (i / 50) ^ 2 + (3 * b.y - a.y - 3 * c.y + d.y) * (i / 50) ^ 3) FROM c, range(50) AS r(i)
  UNION ALL SELECT vec_id, 150, p[4].x, p[4].y FROM q WHERE kind = 1
  UNION ALL SELECT vec_id, k, p[k + 1].x, p[k + 1].y FROM q, range(4) AS r(k) WHERE kind = 2),
l AS (SELECT *, lag(x) OVER o AS ax, lag(y) OVER o AS ay FROM w WINDOW o AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT *, sqrt((x - ax) ^ 2 + (y - ay) ^ 2) AS step, least(greatest(-(ax * (x - ax) + ay * (y - ay)) / ((x - ax) ^ 2 + (y - ay) ^ 2), 0), 1) AS u FROM l WHERE ax <> x OR ay <> y),
t AS (SELECT *, sum(step) OVER (PARTITION BY vec_id ORDER BY i) AS along, sqrt((ax + u * (x - ax)) ^ 2 + (ay + u * (y - ay)) ^ 2) AS far FROM g),
m AS (SELECT *, min(far) OVER (PARTITION BY vec_id) AS least FROM t)
SELECT vec_id, round(max(along), 6) AS length, round(arg_max(along - step + u * step, i) FILTER (far <= least + 1e-9) / max(along), 6) AS progress FROM m GROUP BY 1""")
def curve_lengths(spark, d):
    x, y = F.slice("embedding", 1, 4).cast("array<double>"), F.slice("embedding", 5, 4).cast("array<double>")
    kind = F.element_at(F.array(*map(F.lit, "BCL")), (F.col("vec_id") % 3 + 1).cast("int"))
    total = F.element_at(curves.cumulative_length(kind, x, y), -1)
    near = curves.progress_of(kind, x, y, F.lit(0.0), F.lit(0.0))
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 6).alias("length"), F.round(near, 6).alias("progress"))


@query(f"""WITH {E}, r AS (SELECT user_id, ms, event_type, lag(ms) OVER w AS start, lag(event_type) OVER w AS before FROM e WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
SELECT user_id, start, ms AS "end" FROM r WHERE event_type = 'error' AND before = 'signup'""")
def paired_spans(spark, d):
    """Spinners and holds: each end with the last start before it that no other end has taken."""
    w = Window.partitionBy("user_id").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(spark, d).where("event_type IN ('signup', 'error')").withColumn("is_end", F.col("event_type") == "error")
    rows = rows.withColumn("last", F.last(F.struct("ms", "is_end")).over(w))
    return rows.where("is_end AND NOT last.is_end").select("user_id", F.col("last.ms").alias("start"), F.col("ms").alias("end"))
