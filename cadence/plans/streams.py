"""Queries that read a table as a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.plans.joins import E
from cadence.plans.registry import query, table
from cadence.session import work_path
from cadence.streaming import server


def _event_stream(spark, d):
    """`events` as a stream of files, with its time as a timestamp; a pattern, so that it may be a file or a folder."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return rows.withColumn("at", F.to_timestamp("ts"))


_BATCHED = f"""WITH RECURSIVE {E}, q AS (SELECT user_id, event_id, 1 + event_id % 5 AS units, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM e),
r(user_id, k, event_id, ms, flushed, start, total, batch, filled, oldest) AS (
  SELECT user_id, k, event_id, ms, NULL::BIGINT, 0::BIGINT, units, (units // 16)::BIGINT, units % 16, ms FROM q WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, ms, CASE WHEN late THEN oldest + 7200000 END, was, was + units, b + (was + units) // 16, (was + units) % 16, CASE WHEN was = 0 OR was + units >= 16 THEN ms ELSE oldest END
  FROM (SELECT q.*, r.oldest, r.filled > 0 AND q.ms >= r.oldest + 7200000 AS late, CASE WHEN r.filled > 0 AND q.ms >= r.oldest + 7200000 THEN 0 ELSE r.filled END AS was,
    r.batch + CASE WHEN r.filled > 0 AND q.ms >= r.oldest + 7200000 THEN 1 ELSE 0 END AS b FROM r JOIN q ON q.user_id = r.user_id AND q.k = r.k + 1)
), p AS (
  SELECT user_id, event_id, ms, batch - total // 16 + j AS batch, least(total, (j + 1) * 16) - greatest(start, j * 16) AS units FROM r, unnest(range(0, (total - 1) // 16 + 1)) AS u(j)
), b AS (SELECT user_id, batch, sum(units) AS total, min(ms) AS oldest, max(ms) AS latest FROM p GROUP BY ALL
), w AS (SELECT max(ms) AS mark FROM e)
SELECT user_id, batch::BIGINT AS batch, event_id, units::BIGINT AS units, total = 16 AS "full", CASE WHEN total = 16 THEN latest ELSE oldest + 7200000 END::BIGINT AS closed_ms
FROM p JOIN b USING (user_id, batch), w WHERE total = 16 OR oldest + 7200000 <= mark"""


@query(_BATCHED)
def batching_server(spark, d):
    """Requests (events) of each user in batches of 16 units, closed when full or two hours after their oldest."""
    rows = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("params"), F.col("event_id").alias("seq"), (1 + F.col("event_id") % 5).alias("units"), "at")
    found = server.run_once(server.batched(rows, 16, 7_200_000, "at"), work_path(spark, "batches"), work_path(spark, "batching"))
    since = F.col("closed_ms") - F.expr("unix_millis(timestamp'2024-01-01 00:00:00Z')")
    return found.select(F.col("params").cast("long").alias("user_id"), "batch", F.col("seq").alias("event_id"), "units", "full", since.alias("closed_ms"))


@query(f"""WITH {E}, g AS (SELECT user_id, ms, CASE WHEN ms >= lag(ms) OVER w + 21600000 THEN 1 ELSE 0 END AS fresh, event_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
s AS (SELECT user_id, ms, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM g),
t AS (SELECT user_id, k, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, first_ms, last_ms, n, last_ms + 21600000 AS idle_ms FROM t WHERE last_ms + 21600000 <= (SELECT max(ms) FROM e)""")
def idle_spans(spark, d):
    """Users' spans of activity that ended as nothing came for six hours."""
    rows = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("key"), "at")
    found = server.run_once(server.idle(rows, 21_600_000, "at"), work_path(spark, "idle"), work_path(spark, "idling"))
    since = lambda c: (F.col(c) - F.expr("unix_millis(timestamp'2024-01-01 00:00:00Z')")).alias(c)
    return found.select(F.col("key").cast("long").alias("user_id"), since("first_ms"), since("last_ms"), "n", since("idle_ms"))
