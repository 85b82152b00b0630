"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions import tokens
from cadence.operators import assembly, chart_events
from cadence.operators.aggregates import latest
from cadence.operators.ranking import with_position
from cadence.plans.joins import E, events
from cadence.plans.registry import query, table
from cadence.session import work_path, written
from cadence.sources import catalogue, chart_source, charts, sinks


@query(f"""WITH {E} SELECT user_id, ms // 1000 AS time_ms, (event_id % 512)::DOUBLE AS x, (event_id % 384)::DOUBLE AS y, 'circle' AS kind, false AS new_combo FROM e WHERE event_type = 'click'
UNION ALL SELECT user_id, ms // 1000, 256, 192, 'spinner', true FROM e WHERE event_type = 'signup'""")
def chart_round_trip(spark, d):
    """Charts rendered as text files, one per user, and parsed again: circles from clicks, spinners from signups."""
    rows = events(spark, d).where("event_type IN ('click', 'signup')")
    at = F.expr("ms div 1000")
    none = F.lit(None)
    click = F.col("event_type") == "click"
    group = lambda kind, t, seq: F.struct(F.lit(kind).alias("type"), t.alias("time"), seq.alias("seq"))
    one = F.when(click, F.array(group("circle", at, F.col("event_id") * 2))).otherwise(
        F.array(group("spinner", at, F.col("event_id") * 2), group("spinner_end", at + 50, F.col("event_id") * 2 + 1))
    )
    groups = rows.select(
        F.col("user_id").alias("chart"), F.inline(one), F.when(click, (F.col("event_id") % 512).cast("double")).alias("x"), F.when(click, (F.col("event_id") % 384).cast("double")).alias("y"),
        F.lit(False).alias("new_combo"), F.lit(0).alias("hitsound"), none.cast("int").alias("sample_set"), none.cast("int").alias("addition"),
    )
    # spinner pairs must follow one another, so spinners and circles are assembled on their own
    lines = assembly.hit_object_lines(groups.where("type = 'circle'")).unionByName(assembly.hit_object_lines(groups.where("type <> 'circle'")))
    header = lines.select("chart").distinct().withColumn("header", F.lit("format v14\n\n[General]\nMode: 0\n"))
    path = work_path(spark, "charts")
    chart_source.write_charts(sinks.chart_text(header, lines.limit(0), lines, "chart"), path, "chart")
    objects = charts.hit_objects(chart_source.read_charts(spark, path).where("section = 'HitObjects'"))
    user = F.regexp_extract("file", r"/(\d+)\.txt$", 1).cast("long")
    return objects.select(user.alias("user_id"), "time_ms", "x", "y", "kind", "new_combo")


@query("SELECT o_orderkey AS beatmap_id, o_totalprice AS weight FROM orders")
def weights_csv_round_trip(spark, d):
    path = work_path(spark, "weights")
    sinks.scores_csv(table(spark, d, "orders"), path, "o_orderkey", "o_totalprice")
    return catalogue.weights(spark, path)


@query("SELECT event_id AS seq, least(greatest(value, -256), 768) AS x, least(greatest(value * 2 - 100, -256), 640) AS y, (event_type = 'click')::INT::DOUBLE AS click, (event_type = 'view')::INT::DOUBLE AS view FROM events")
def datapoints(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("chart"), F.col("event_id").alias("seq"), F.col("ms").alias("time_ms"), F.col("value").alias("x"), (F.col("value") * 2 - 100).alias("y"), F.col("event_type").alias("kind"))
    v = assembly.datapoints(rows, ["click", "view"])
    return v.select("seq", *(F.col("features")[i].alias(n) for i, n in ((0, "x"), (1, "y"), (3, "click"), (4, "view"))))


_CATALOGUE = """SELECT o_custkey AS BeatmapSetId, o_orderkey AS Id, (o_orderkey % 100000)::INT AS BeatmapIdx, 'set ' || o_custkey AS BeatmapSetFolder, (o_orderkey % 4)::INT AS ModeInt,
o_orderdate AS RankedDate, o_totalprice / 60000 AS DifficultyRating, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS OmdbTags FROM orders"""


def _catalogue(spark, d):
    """Orders as a chart catalogue; tags are missing for every third."""
    rows = table(spark, d, "orders")
    price = F.col("o_totalprice") / 60000
    return rows.select(
        F.col("o_custkey").alias("BeatmapSetId"), F.col("o_orderkey").alias("Id"), (F.col("o_orderkey") % 100_000).cast("int").alias("BeatmapIdx"),
        F.concat(F.lit("set "), "o_custkey").alias("BeatmapSetFolder"), F.lit("a.mp3").alias("AudioFile"), F.lit("b.txt").alias("BeatmapFile"),
        (F.col("o_orderkey") % 4).cast("int").alias("ModeInt"), F.col("o_orderdate").alias("RankedDate"), F.col("o_orderdate").alias("SubmittedDate"),
        price.alias("DifficultyRating"), F.array(price, price * 2).alias("StarRating"), F.col("o_custkey").alias("UserId"),
        F.when(F.col("o_orderkey") % 3 > 0, F.array("o_orderpriority")).alias("OmdbTags"),
    )


@query(_CATALOGUE)
def chart_catalogue(spark, d):
    path = work_path(spark, "catalogue")
    _catalogue(spark, d).write.parquet(path)
    rows = catalogue.charts(spark, path)
    return rows.select("BeatmapSetId", "Id", "BeatmapIdx", "BeatmapSetFolder", "ModeInt", "RankedDate", "DifficultyRating", F.col("OmdbTags")[0].alias("OmdbTags"))


@query(f"SELECT BeatmapSetId, Id, DifficultyRating FROM ({_CATALOGUE}) WHERE ModeInt = 0 AND DifficultyRating > 2 AND OmdbTags IS NOT NULL")
def catalogue_pruned(spark, d):
    """The catalogue read through filters and columns that reach the scan."""
    path = work_path(spark, "catalogue")
    _catalogue(spark, d).write.parquet(path)
    return catalogue.charts(spark, path).where("ModeInt = 0 AND DifficultyRating > 2 AND OmdbTags IS NOT NULL").select("BeatmapSetId", "Id", "DifficultyRating")


def _tracks(spark, d):
    """Regions as tracks, one JSON file each, with their nations as charts."""
    c = F.col
    chart = F.struct(
        c("n_nationkey").alias("BeatmapId"), c("n_nationkey").alias("Index"), F.lit(4.0).alias("CircleSize"),
        F.create_map(F.lit("0"), c("n_nationkey") / 4, F.lit("64"), c("n_nationkey") / 2).alias("StandardStarRating"),
    )
    rows = table(spark, d, "region").join(table(spark, d, "nation"), c("r_regionkey") == c("n_regionkey"))
    one = rows.groupBy("r_regionkey", "r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", chart))).alias("Beatmaps"))
    text = F.to_json(F.struct(c("r_regionkey").alias("BeatmapSetId"), c("r_name").alias("Artist"), F.concat("r_name", F.lit(" title")).alias("Title"), "Beatmaps"), {"pretty": "true"})
    path = work_path(spark, "tracks")
    one.select("r_regionkey", text.alias("value")).write.partitionBy("r_regionkey").text(path)
    return catalogue.tracks(spark, f"{path}/*/*.txt")


@query("SELECT r_regionkey::BIGINT AS BeatmapSetId, r_name AS Artist, r_name || ' title' AS Title, count(*)::INT AS charts FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def track_json(spark, d):
    return _tracks(spark, d).select("BeatmapSetId", "Artist", "Title", F.size("Beatmaps").alias("charts"))


@query("SELECT n_regionkey::BIGINT AS BeatmapSetId, n_name AS Version, n_nationkey::BIGINT AS BeatmapId, 4.0::DOUBLE AS CircleSize, n_nationkey / 4 AS Stars, n_nationkey / 2 AS StarsFast FROM nation")
def flat_charts(spark, d):
    return catalogue.flat_charts(_tracks(spark, d)).select("BeatmapSetId", "Version", "BeatmapId", "CircleSize", "Stars", "StarsFast")


@query("SELECT p_partkey AS beatmap_id, p_type AS descriptor FROM part")
def descriptors_csv(spark, d):
    path = work_path(spark, "descriptors")
    table(spark, d, "part").select("p_partkey", "p_type").write.csv(path)
    return catalogue.descriptors(spark, path)


@query("SELECT s_suppkey AS id, s_suppkey * 10 AS user_id, s_name || ',' || 'old ' || s_name AS names FROM supplier")
def mappers_json(spark, d):
    """Files that each hold a JSON list, one per nation."""
    one = F.struct(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 10).alias("user_id"), F.array("s_name", F.concat(F.lit("old "), "s_name")).alias("username"))
    rows = table(spark, d, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 16).alias("file")).agg(F.to_json(F.collect_list(one)).alias("value"))
    path = work_path(spark, "mappers")
    rows.write.partitionBy("s_nationkey", "file").text(path)
    return catalogue.mappers(spark, f"{path}/*/*/*.txt").select("id", "user_id", F.array_join("username", ",").alias("names"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 > 0")
def id_list(spark, d):
    """A list of ids as lines, with blank and other lines in between."""
    path = work_path(spark, "ids")
    line = F.when(F.col("o_orderkey") % 5 > 0, F.format_string(" %d ", "o_orderkey")).when(F.col("o_orderkey") % 10 > 0, F.lit("")).otherwise(F.lit("none"))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return catalogue.ids(spark, path)


@query("SELECT n_nationkey AS track FROM nation WHERE n_nationkey BETWEEN 5 AND 14")
def numbered_files(spark, d):
    path = work_path(spark, "numbered")
    rows = table(spark, d, "nation").select(F.format_string("Track%05d", "n_nationkey").alias("folder"), F.col("n_name").alias("value"))
    rows.write.partitionBy("folder").text(path)
    return catalogue.numbered_files(spark, f"{path}/*/*.txt", 5, 15).select("track")


@query("""WITH m AS (SELECT user_id, event_id, value, CASE event_type WHEN 'click' THEN 'FID' WHEN 'view' THEN 'Active F1' END AS metric FROM events)
SELECT user_id, arg_max(round(value, 2), event_id) FILTER (metric = 'FID') AS "FID", arg_max(round(value, 2), event_id) FILTER (metric = 'Active F1') AS "Active F1" FROM m WHERE metric IS NOT NULL GROUP BY 1""")
def metric_logs(spark, d):
    """Logs of runs (users) with lines of metrics and of noise, and the last value of each metric."""
    name = F.when(F.col("event_type") == "click", "FID").when(F.col("event_type") == "view", "Active F1").otherwise("noise")
    line = F.format_string("%s: %.2f", name, F.round("value", 2))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("text")))).alias("lines"))
    path = work_path(spark, "logs")
    chart_source.write_charts(rows.select("user_id", F.array_join("lines.text", "\n").alias("value")), path, "user_id", ".log")
    names = ["FID", "Active F1"]
    lines = chart_source.read_charts(spark, path, suffix=".log", plain="true")
    found = catalogue.metric_lines(lines, names).withColumn("user_id", F.regexp_extract("file", r"/(\d+)\.log$", 1).cast("long"))
    return latest(found, "user_id", "metric", "value", "line", names).where(F.col("FID").isNotNull() | F.col("Active F1").isNotNull())


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def replaced_parquet(spark, d):
    """A table filtered and written over itself."""
    path = work_path(spark, "replaced")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice").write.parquet(path)
    sinks.replace_parquet(spark.read.parquet(path).where("o_totalprice > 100000"), path)
    return sinks.read_back(spark, path)


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM orders WHERE o_totalprice > 100000")
def committed_versions(spark, d):
    """A table of versions: written, then twice replaced by what is read from itself."""
    path = work_path(spark, "versions")
    sinks.commit(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), path)
    sinks.commit(sinks.committed(spark, path).where("o_totalprice > 100000"), path)
    sinks.commit(sinks.committed(spark, path).select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled")), path)
    return sinks.committed(spark, path)


@query("""SELECT '<tr><td>' || o_orderkey || '</td><td>' || replace(replace(o_orderpriority || ' <' || o_orderstatus || '&>', '&', '&amp;'), '<', '&lt;') || '</td></tr>' AS value FROM orders""")
def html_report(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(" <"), "o_orderstatus", F.lit("&>")).alias("note"))
    path = work_path(spark, "html")
    sinks.html_rows(rows, ["o_orderkey", "note"]).write.text(path)
    return spark.read.text(path)


@query("""WITH c AS (SELECT event_type AS type, min(trunc(value)::INT) AS lo, max(trunc(value)::INT) AS hi FROM events GROUP BY 1)
SELECT type, lo, hi, (3 + sum(hi - lo + 1) OVER w - (hi - lo + 1))::BIGINT AS tok_start, (3 + sum(hi - lo + 1) OVER w)::BIGINT AS tok_end FROM c WINDOW w AS (ORDER BY type)""")
def saved_vocabulary(spark, d):
    """A vocabulary of the events' own types and value ranges, saved and loaded."""
    whole = F.col("value").cast("int")
    ranges = table(spark, d, "events").groupBy(F.col("event_type").alias("type")).agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    path = work_path(spark, "vocabulary")
    sinks.vocabulary(tokens.layout(with_position(ranges, ["type"], "seq"), 3), path)
    return sinks.read_back(spark, path)


@query("""WITH n AS (SELECT o_orderkey, o_orderpriority || '.txt' AS f, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS k, o_custkey FROM orders)
SELECT o_orderkey, o_custkey || '/' || CASE WHEN k = 0 THEN f ELSE replace(f, '.txt', ' (' || k || ').txt') END AS name FROM n""")
def unique_names(spark, d):
    name = F.concat(F.col("o_custkey"), F.lit("/"), F.col("o_orderpriority"), F.lit(".txt"))
    return sinks.unique_names(table(spark, d, "orders").select("o_orderkey", name.alias("name")), "name", "o_orderkey")


@query("SELECT event_type, least(floor(value / 50)::INT, 19) AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value >= 0 GROUP BY ALL")
def binned_metrics(spark, d):
    """Metrics per bin, written in folders by bin and read again."""
    rows = table(spark, d, "events").where("value >= 0").withColumn("bin", F.least(F.floor(F.col("value") / 50).cast("int"), F.lit(19)))
    path = work_path(spark, "metrics")
    sinks.metrics(rows.groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")), path, "bin")
    return sinks.read_back(spark, path)


@query("SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS balance FROM customer WHERE c_acctbal > 0")
def saved_table(spark, d):
    """A result kept as a table in the shared folder, which later steps read instead of computing it again."""
    kept = written(table(spark, d, "customer").where("c_acctbal > 0"), "customers")
    return kept.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("balance"))


@query(f"""WITH {E}, o AS (SELECT user_id, event_type, ms // 1000 AS t, (event_id % 512)::DOUBLE AS x, (event_id % 384)::DOUBLE AS y, event_id % 5 = 0 AS combo, (event_id % 8)::INT AS sound,
  row_number() OVER (PARTITION BY user_id ORDER BY ms // 1000, event_id) AS k FROM e WHERE event_type IN ('click', 'signup')),
p AS (SELECT *, lag(CASE WHEN event_type = 'click' THEN x ELSE 256 END, 1, 256.0) OVER w AS px, lag(CASE WHEN event_type = 'click' THEN y ELSE 192 END, 1, 192.0) OVER w AS py FROM o WINDOW w AS (PARTITION BY user_id ORDER BY k)),
g AS (SELECT user_id, t, k, 0 AS g, CASE event_type WHEN 'click' THEN 'circle' ELSE 'spinner' END AS kind, x, y, px, py, combo, CASE event_type WHEN 'click' THEN sound END AS sound FROM p
  UNION ALL SELECT user_id, t + 50, k, 1, 'spinner_end', NULL, NULL, NULL, NULL, false, sound FROM p WHERE event_type = 'signup'),
d AS (SELECT t, min(i) AS i FROM (SELECT DISTINCT t FROM g), unnest(range(1, 17)) AS r(i) WHERE abs(t / 500.0 - round_even(t / 500.0 * i, 0) / i) * 500 < 2 GROUP BY 1),
v AS (SELECT user_id, t AS time_ms, k, g, 1 AS part, 'time_shift' AS type, t AS value FROM g
  UNION ALL SELECT user_id, g.t, k, g, 2, 'snapping', coalesce(i, 0) FROM g LEFT JOIN d ON g.t = d.t
  UNION ALL SELECT user_id, t, k, g, 3, 'distance', trunc(least(sqrt((x - px) ^ 2 + (y - py) ^ 2), 640))::BIGINT FROM g WHERE kind = 'circle'
  UNION ALL SELECT user_id, t, k, g, 4, 'pos_x', x::BIGINT FROM g WHERE kind = 'circle'
  UNION ALL SELECT user_id, t, k, g, 5, 'pos_y', y::BIGINT FROM g WHERE kind = 'circle'
  UNION ALL SELECT user_id, t, k, g, 6, 'new_combo', 0 FROM g WHERE kind = 'circle' AND combo
  UNION ALL SELECT user_id, t, k, g, 8, 'hitsound', (sound & 14) // 2 + 32 FROM g WHERE sound IS NOT NULL
  UNION ALL SELECT user_id, t, k, g, 9, 'volume', CASE WHEN t + 5 >= 1000000 THEN 40 ELSE 60 END FROM g WHERE sound IS NOT NULL
  UNION ALL SELECT user_id, t, k, g, 10, kind, 0 FROM g)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY time_ms, k, g, part) - 1 AS place, time_ms, type, value FROM v""")
def chart_to_events(spark, d):
    """Charts of clicks as circles and signups as spinners, at 500 ms a beat and with two volumes, as event streams."""
    rows = events(spark, d).where("event_type IN ('click', 'signup')")
    click, at = F.col("event_type") == "click", F.expr("ms div 1000")
    objects = rows.select(
        F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("seq"), (F.col("event_id") % 512).cast("double").alias("x"), (F.col("event_id") % 384).cast("double").alias("y"),
        at.alias("time_ms"), F.when(click, "circle").otherwise("spinner").alias("kind"), (click & (F.col("event_id") % 5 == 0)).alias("new_combo"),
        (F.col("event_id") % 8).cast("int").alias("hitsound"), F.when(click, F.array(F.lit("0:0:0:0:"))).otherwise(F.array((at + 50).cast("string"), F.lit("0:0:0:0:"))).alias("params"),
    )
    first = F.struct(*(F.lit(v).alias(n) for n, v in (("seq", 0), ("offset_ms", 0), ("value", 500.0), ("meter", 4), ("sample_type", 2), ("sample_set", 0), ("volume", 60), ("is_red", True), ("kiai", False))))
    second = F.struct(*(F.lit(v).alias(n) for n, v in (("seq", 1), ("offset_ms", 1_000_000), ("value", -50.0), ("meter", 4), ("sample_type", 2), ("sample_set", 0), ("volume", 40), ("is_red", False), ("kiai", True))))
    points = objects.select("file").distinct().select("file", F.inline(F.array(first, second)))
    found = chart_events.events(objects, points)
    return found.select(F.col("file").cast("long").alias("user_id"), "place", "time_ms", "type", "value")


def _rendered(spark, d, kinds: list[tuple[str, int]], where: str):
    """Lines of hit objects whose groups are `kinds` (type, milliseconds after the start) at places by event id."""
    rows = events(spark, d).where(where)
    at = F.expr("ms div 1000")
    one = lambda k, kind, after: F.struct(
        F.lit(kind).alias("type"), (at + after).alias("time"), (F.col("event_id") * 16 + k).alias("seq"), ((F.col("event_id") * (k + 3)) % 512).cast("double").alias("x"),
        ((F.col("event_id") * (k + 5)) % 384).cast("double").alias("y"),
    )
    groups = rows.select(
        F.col("user_id").alias("chart"), F.inline(F.array(*(one(k, kind, after) for k, (kind, after) in enumerate(kinds)))), (F.col("event_id") % 2 == 0).alias("new_combo"),
        (F.col("event_id") % 8 * 2).cast("int").alias("hitsound"), (F.col("event_id") % 4).cast("int").alias("sample_set"), F.lit(1).alias("addition"),
    )
    return assembly.hit_object_lines(groups).select(F.col("chart").alias("user_id"), F.floor(F.col("seq") / 16).alias("event_id"), "text")


_SPOT = "((event_id * {0}) % 512) || ':' || ((event_id * {1}) % 384)"


@query(f"""WITH {E}, r AS (SELECT *, ms // 1000 AS t FROM e WHERE event_type = 'view')
SELECT user_id, event_id, ((event_id * 3) % 512) || ',' || ((event_id * 5) % 384) || ',' || t || ',' || CASE WHEN event_id % 2 = 0 THEN 6 ELSE 2 END || ',' || (event_id % 8 * 2) || ',B|' || {_SPOT.format(4, 6)} || '|' || {_SPOT.format(5, 7)} || '|' || {_SPOT.format(5, 7)} || '|' || {_SPOT.format(6, 8)}
  || ',3,100,' || (event_id % 4) || ':1:0:0:' AS text FROM r""")
def slider_lines(spark, d):
    """Views as sliders: a curved and a corner anchor, three spans of 100 ms."""
    kinds = [("slider_head", 0), ("bezier_anchor", 0), ("red_anchor", 0), ("last_anchor", 100), ("slider_end", 300)]
    return _rendered(spark, d, kinds, "event_type = 'view'")


@query(f"""WITH {E}, r AS (SELECT *, ms // 1000 AS t FROM e WHERE event_type = 'error')
SELECT user_id, event_id, ((event_id * 3) % 512) || ',192,' || t || ',128,' || (event_id % 8 * 2) || ',' || (t + 70) || ':' || (event_id % 4) || ':1:0:0:' AS text FROM r""")
def hold_lines(spark, d):
    """Errors as held notes of 70 ms."""
    return _rendered(spark, d, [("hold", 0), ("hold_end", 70)], "event_type = 'error'")


@query(f"""WITH {E}, r AS (SELECT *, ms // 1000 AS t, (event_id % 512)::DOUBLE AS x, (event_id % 384)::DOUBLE AS y, 40 + event_id % 100 AS len FROM e WHERE event_type = 'view'),
s AS (SELECT user_id, event_id, t, x, y, len, len / 280.0 * 500 AS span FROM r)
SELECT user_id, event_id, k AS step, CASE k WHEN 0 THEN t WHEN 1 THEN trunc(t + span)::BIGINT ELSE trunc(t + 2 * span)::BIGINT END AS time_ms, trunc(CASE k WHEN 0 THEN x WHEN 1 THEN x + 30 ELSE x + len END)::BIGINT AS pos_x FROM s, range(3) AS g(k)""")
def slider_events(spark, d):
    """Straight sliders of two spans at twice the speed: times and places of head, last control point and end."""
    rows = events(spark, d).where("event_type = 'view'")
    x, y = (F.col("event_id") % 512).cast("double"), (F.col("event_id") % 384).cast("double")
    curve = F.concat(F.lit("L|"), (x + 30).cast("string"), F.lit(":"), y.cast("string"))
    objects = rows.select(
        F.concat_ws("/", "user_id", "event_id").alias("file"), F.col("event_id").alias("seq"), x.alias("x"), y.alias("y"), F.expr("ms div 1000").alias("time_ms"), F.lit("slider").alias("kind"),
        F.lit(False).alias("new_combo"), F.lit(0).alias("hitsound"), F.array(curve, F.lit("2"), (40 + F.col("event_id") % 100).cast("string")).alias("params"),
    )
    point = lambda seq, value, red: F.struct(*(F.lit(v).alias(n) for n, v in (("seq", seq), ("offset_ms", 0), ("value", value), ("meter", 4), ("sample_type", 2), ("sample_set", 0), ("volume", 60), ("is_red", red), ("kiai", False))))
    points = objects.select("file", F.inline(F.array(point(0, 500.0, True), point(1, -50.0, False))))
    found = chart_events.events(objects, points, chart_events.Options(snapping=False, distances=False, hitsounds=False))
    parts = F.split("file", "/")
    places = found.where("type IN ('pos_x', 'time_shift')").groupBy("file", "time_ms").agg(F.max(F.when(F.col("type") == "pos_x", F.col("value"))).alias("pos_x"), F.min("place").alias("place"))
    step = F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1
    return places.select(parts[0].cast("long").alias("user_id"), parts[1].cast("long").alias("event_id"), step.cast("long").alias("step"), "time_ms", "pos_x")


@query(f"""WITH {E}, u AS (SELECT user_id, count(*) AS n, max(event_id) AS last FROM e GROUP BY 1)
SELECT user_id, 'Metadata' AS section, 'Title' AS key, 'user ' || user_id AS value FROM u UNION ALL SELECT user_id, 'Metadata', 'Version', 'v' || n FROM u
UNION ALL SELECT user_id, 'Difficulty', 'CircleSize', (last % 7)::VARCHAR FROM u""")
def chart_settings(spark, d):
    """A chart file for each user with all their events; settings read again without timing points and objects."""
    rows = events(spark, d).select("user_id", "event_id", (F.col("event_id") % 512).alias("x"), F.expr("ms div 1000").alias("t"))
    text = F.concat_ws(",", "x", F.lit(192), "t", F.lit(1), F.lit(0), F.lit("0:0:0:0:"))
    users = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    settings = F.concat(
        F.lit("format v14\n\n[General]\nMode: 0\n\n[Metadata]\nTitle:user "), "user_id", F.lit("\nVersion:v"), "n", F.lit("\n// a comment\n\n[Difficulty]\nCircleSize:"), F.col("last") % 7, F.lit("\n")
    )
    header = users.select("user_id", settings.alias("header"))
    points = users.select("user_id", F.lit(0).alias("seq"), F.lit("0,500,4,2,0,60,1,0").alias("text"))
    folder = work_path(spark, "charts")
    chart_source.write_charts(sinks.chart_text(header, points, rows.select("user_id", F.col("event_id").alias("seq"), text.alias("text")), "user_id"), folder, "user_id")
    lines = chart_source.read_charts(spark, folder).where("section IN ('Metadata', 'Difficulty')")
    return charts.settings(lines).select(F.regexp_extract("file", r"/(\d+)\.txt$", 1).cast("long").alias("user_id"), "section", "key", "value")
