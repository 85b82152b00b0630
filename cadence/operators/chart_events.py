"""Charts to event streams: each hit object becomes groups of events, merged with tempo, kiai and scroll speed changes.

A group is a type with what goes with it: a time, its snap divisor, distance and position (or column), new combo,
scroll speed, and the sounds of one or more moments. Groups are rows; what holds at a time (beat, speed, samples) is
looked up as of it, and a group's events are the elements of one array. All is DataFrame work, partitioned by file;
only a curve's end is found in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions import curves
from cadence.functions.scalars import column_of, pack_hitsound, pack_position, sample_field, snap_divisor, sped
from cadence.operators.aggregates import dominant_period
from cadence.operators.joins import asof
from cadence.operators.windows import beat_grid, normalized_speeds, ordered

#: The modes of play.
STANDARD, DRUMS, CATCH, COLUMNS = 0, 1, 2, 3
#: Fixed value: the middle of the field, from which the first distance and the one after a spinner count.
MIDDLE = (256.0, 192.0)
#: Order of a group's parts.
_PARTS = {"type_first": 0, "time": 1, "snap": 2, "distance": 3, "x": 4, "y": 5, "combo": 6, "speed": 7, "sound": 8, "type_last": 9}


@dataclass(frozen=True)
class Options:
    """What to emit. With `types_first` a group starts with its type, else it ends with it. `anchor_times`: anchors lie
    spread over a slider's first span and its last anchor has a place; else they take the slider's start, and the last
    anchor comes twice, first with its place, then with its time. Sliders of `most_points` control points or more give
    no events (None: all do)."""

    types_first: bool = False
    snapping: bool = True
    distances: bool = True
    positions: bool = True
    split_axes: bool = True
    hitsounds: bool = True
    slider_speed: bool = False
    anchor_times: bool = True
    kiai: bool = False
    timing: bool = False
    timing_points: bool = False
    scroll_speeds: bool = False
    normalized: bool = True
    precision: int = 1
    low: tuple[int, int] = (-256, -256)
    high: tuple[int, int] = (768, 640)
    most_distance: int = 640
    most_points: int | None = 100
    speed: float = 1.0


def _points(points: DataFrame) -> DataFrame:
    """Timing points in order, each with the beat in force and its own scroll speed; keyed by time as a number."""
    rows = points.withColumn("seq", F.col("seq") * 2 + (~F.col("is_red")).cast("int"))
    w = ordered("file", "offset_ms", "seq")
    red = F.when(F.col("is_red"), F.struct(F.col("offset_ms").alias("at"), F.col("value").alias("beat_ms")))
    first = F.first(red, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    beat = F.coalesce(F.last(red, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first)
    own = F.when(F.col("is_red") | (F.col("value") >= 0) | F.isnan("value"), F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(-100.0) / F.col("value"), F.lit(0.01)), F.lit(10.0)))
    return rows.select("file", F.col("offset_ms").cast("double").alias("at_ms"), "seq", beat.alias("beat"), own.alias("own_speed"), "sample_type", "volume")


def _as_of(rows: DataFrame, points: DataFrame, time: Column, values: list[str]) -> DataFrame:
    """`rows` with `values` of the last timing point at or before a time; before the first one, of that."""
    return asof(rows.withColumn("at_ms", time), points, "file", "at_ms", values, seq="seq", or_first=True).drop("at_ms")


def _number(array: Column, i: int, default: float) -> Column:
    return F.coalesce(F.get(array, F.lit(i)).try_cast("double"), F.lit(float(default)))


def groups(objects: DataFrame, points: DataFrame, options: Options = Options()) -> DataFrame:
    """(file, at, g, type, time, has_time, x, y, from_middle, combo, column, scroll, sounds) of hit objects.

    `objects` are rows (file, seq, x, y, time_ms, kind, new_combo, hitsound, params), and may have `mode` (0 standard,
    1 drums, 2 catch, 3 columns; 0 if absent), `slider_multiplier` (1.4) and `columns` (4). time is a number of
    milliseconds, not yet cut; sounds are (time, hitsound, addition) of the moments whose sounds the group tells.
    """
    rows = objects
    for name, default in (("mode", 0), ("slider_multiplier", 1.4), ("columns", 4)):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(default))
    order = F.row_number().over(ordered("file", "time_ms", "seq"))
    rows = rows.withColumn("at", order).withColumn("t", F.col("time_ms").cast("double"))
    # the curve is worked out below the window of the look-up, so that uses of it read what is there
    spot = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    parts = F.split(F.get("params", F.lit(0)), r"\|")
    place = lambda a: spot(F.split(a, ":")[0].try_cast("double"), F.get(F.split(a, ":"), F.lit(1)).try_cast("double"))
    rows = rows.withColumn("curve", F.concat(F.array(spot(F.col("x"), F.col("y"))), F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), place)))
    rows = rows.withColumn("n", F.size("curve"))
    letter = F.substring(F.get("params", F.lit(0)), 1, 1)
    c = lambda i: F.get("curve", F.lit(i))
    bend = (c(1)["x"] - c(0)["x"]) * (c(2)["y"] - c(0)["y"]) - (c(1)["y"] - c(0)["y"]) * (c(2)["x"] - c(0)["x"])
    letter = F.when((letter == "P") & ((F.col("n") != 3) | (bend == 0)), "B").otherwise(letter)
    rows = rows.withColumn("letter", letter)
    rows = _as_of(rows, points, F.col("t"), ["beat", "own_speed"])
    rows = rows.withColumn("repeats", F.greatest(_number(F.col("params"), 1, 1).cast("int"), F.lit(1)))
    length = _number(F.col("params"), 2, 0)
    rows = rows.withColumn("span", length / (F.lit(100.0) * F.col("slider_multiplier") * F.coalesce("own_speed", F.lit(1.0))) * F.coalesce("beat.beat_ms", F.lit(1000.0)))
    slider = F.col("kind") == "slider"
    tip = curves.point_at(F.col("letter"), F.transform("curve", lambda p: p.x), F.transform("curve", lambda p: p.y), length)
    rows = rows.withColumn("tip", F.when(slider, tip))

    none = F.lit(None).cast("double")
    yes, no = F.lit(True), F.lit(False)
    t, drums = F.col("t"), F.col("mode") == DRUMS
    sound = lambda at, what, addition: F.struct(at.alias("t"), what.cast("int").alias("hitsound"), addition.alias("addition"))
    silent = F.array().cast("array<struct<t:double,hitsound:int,addition:string>>")
    own_sound = lambda at, i: F.array(sound(at, F.col("hitsound"), F.coalesce(F.get("params", F.lit(i)), F.lit("0:0"))))
    speed = lambda on: F.when(on, F.coalesce("own_speed", F.lit(1.0)))

    def group(kind, at, has_time=yes, x=none, y=none, combo=no, scroll=none, sounds=silent):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), at.alias("time"), has_time.alias("has_time"), x.alias("x"), y.alias("y"), combo.alias("combo"), scroll.cast("double").alias("scroll"), sounds.alias("sounds"))

    x, y, combo = F.col("x"), F.col("y"), F.coalesce("new_combo", no)
    circle = F.array(group("circle", t, x=x, y=y, combo=combo, scroll=speed(drums), sounds=own_sound(t, 0)))
    edges, adds = F.split(F.coalesce(F.get("params", F.lit(3)), F.lit("")), r"\|"), F.split(F.coalesce(F.get("params", F.lit(4)), F.lit("")), r"\|")
    edge = lambda i: sound(t + i * F.col("span"), F.coalesce(F.get(edges, i).try_cast("int"), F.lit(0)), F.coalesce(F.nullif(F.get(adds, i), F.lit("")), F.lit("0:0")))
    # the last edge's sounds are the last ones listed, however many edges there are
    end_sound = sound(t + F.col("repeats") * F.col("span"), F.coalesce(F.element_at(edges, -1).try_cast("int"), F.lit(0)), F.coalesce(F.nullif(F.element_at(adds, -1), F.lit("")), F.lit("0:0")))
    kinds = F.create_map(*(F.lit(v) for kv in {"L": "red_anchor", "C": "catmull_anchor", "P": "perfect_anchor"}.items() for v in kv))

    def anchor(p: Column, i: Column) -> Column:
        before, after = F.get("curve", i - 1), F.get("curve", i + 1)
        curved = F.when(p == after, "red_anchor").when(p != before, "bezier_anchor")
        at = t + i / (F.col("n") - 1) * F.col("span") if options.anchor_times else t
        return group(F.when(F.col("letter").isin("L", "C", "P"), F.element_at(kinds, F.col("letter"))).otherwise(curved), at, has_time=no, x=p.x, y=p.y)

    inner = F.filter(F.transform("curve", anchor), lambda g, i: (i > 0) & (i < F.col("n") - 1) & g["type"].isNotNull())
    last = F.element_at("curve", -1)
    body = F.array(sound(t + 1, F.col("hitsound"), F.coalesce(F.get("params", F.lit(5)), F.lit("0:0"))))
    body = F.concat(body, F.when(F.col("repeats") > 1, F.transform(F.sequence(F.lit(1), F.col("repeats") - 1), edge)).otherwise(silent))
    turn = t + F.col("span")
    ends = [group("last_anchor", turn, x=last["x"], y=last["y"], sounds=body)] if options.anchor_times else [group("last_anchor", t, has_time=no, x=last["x"], y=last["y"]), group("last_anchor", turn, sounds=body)]
    stop = t + F.col("repeats") * F.col("span")
    whole = F.concat(
        F.array(group("slider_head", t, x=x, y=y, combo=combo, scroll=speed(F.lit(options.slider_speed)), sounds=F.array(edge(F.lit(0))))),
        inner, F.array(*ends), F.array(group("slider_end", stop, x=F.col("tip.x"), y=F.col("tip.y"), sounds=F.array(end_sound))),
    )
    roll = F.array(group("drumroll", t, scroll=speed(yes), sounds=own_sound(t, 5)), group("drumroll_end", stop))
    over = _number(F.col("params"), 0, 0)
    spin = F.array(group("spinner", t), group("spinner_end", over, sounds=own_sound(over, 1)))
    den = F.array(group("denden", t, scroll=speed(yes), sounds=own_sound(t, 1)), group("denden_end", over))
    tail = F.split(F.get("params", F.lit(0)), ":", 2)
    held_sound = F.array(sound(t, F.col("hitsound"), F.coalesce(F.get(tail, F.lit(1)), F.lit("0:0"))))
    hold = F.array(group("hold_note", t, x=x, y=y, sounds=held_sound), group("hold_note_end", _number(tail, 0, 0), x=x, y=y))
    run = (
        F.when(F.col("kind") == "circle", circle).when(slider & drums, roll).when(slider, whole).when((F.col("kind") == "spinner") & drums, den)
        .when(F.col("kind") == "spinner", spin).when(F.col("kind") == "hold", hold)
    )
    if options.most_points is not None:
        rows = rows.where(~slider | drums | (F.col("n") < options.most_points))
    middle = (F.col("kind") == "spinner") & ~drums
    rows = rows.select("file", "at", "mode", F.col("columns").cast("int").alias("columns"), middle.alias("from_middle"), F.posexplode(run).alias("g", "e"))
    return rows.select("file", "at", "g", "mode", "columns", "from_middle", "e.*")


def _array_of(parts: list[tuple[str, Column, Column, Column]]) -> Column:
    """Array of (part, k, type, value) of (part name, condition, type, value)."""
    made = [F.when(on, F.struct(F.lit(_PARTS[part]).alias("part"), F.lit(0).alias("k"), kind.alias("type"), value.cast("long").alias("value"))) for part, on, kind, value in parts]
    return F.array_compact(F.array(*made))


def _events_of(rows: DataFrame, points: DataFrame, source: int, options: Options) -> DataFrame:
    """(file, time_ms, source, at, g, part, k, type, value) of groups."""
    yes = F.lit(True)
    rows = rows.withColumn("time_ms", F.col("time").cast("long"))
    rows = _as_of(rows, points, F.col("time"), ["beat"])
    zero = F.lit(0)
    beats = (F.col("time") - F.col("beat.at")) / F.col("beat.beat_ms")
    # the place before: the last group with a place, or the middle after a spinner
    spot = F.when(F.col("from_middle"), F.struct(F.lit(MIDDLE[0]).alias("x"), F.lit(MIDDLE[1]).alias("y"))).when(F.col("x").isNotNull(), F.struct("x", "y"))
    before = F.last(spot, ignorenulls=True).over(ordered("file", "at", "g").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    far = F.hypot(F.col("x") - F.coalesce("before.x", F.lit(MIDDLE[0])), F.col("y") - F.coalesce("before.y", F.lit(MIDDLE[1])))
    on_field = F.col("mode").isin(STANDARD, CATCH)
    placed = F.col("x").isNotNull() & on_field
    cell = lambda c, i: F.least(F.greatest(c / options.precision, F.lit(options.low[i] / options.precision)), F.lit(options.high[i] / options.precision)).cast("int")
    kind = lambda name: F.lit(name)
    kind_value = F.col("own_value") if "own_value" in rows.columns else zero
    parts = [
        ("type_first" if options.types_first else "type_last", yes, F.col("type"), kind_value),
        ("time", F.col("has_time"), kind("time_shift"), F.col("time_ms")),
        ("snap", F.col("has_time") & F.col("snapped") & F.lit(options.snapping), kind("snapping"), snap_divisor(beats, F.col("beat.beat_ms"))),
        ("distance", placed & F.lit(options.distances), kind("distance"), F.least(F.greatest(far, F.lit(0)), F.lit(options.most_distance))),
        ("combo", F.col("combo") & on_field, kind("new_combo"), zero),
        ("speed", F.col("scroll").isNotNull(), kind("scroll_speed"), F.bround(F.least(F.greatest(F.col("scroll"), F.lit(0.01)), F.lit(10.0)) * 100, 0)),
        ("x", F.col("x").isNotNull() & (F.col("mode") == COLUMNS), kind("mania_column"), column_of(F.col("x"), F.col("columns"))),
    ]
    if options.positions and options.split_axes:
        parts += [("x", placed, kind("pos_x"), cell(F.col("x"), 0)), ("y", placed, kind("pos_y"), cell(F.col("y"), 1))]
    elif options.positions:
        parts.append(("x", placed, kind("pos"), pack_position(F.col("x"), F.col("y"), options.precision, options.low, options.high)))
    keys = ["file", "time_ms", F.lit(source).alias("source"), "at", "g"]
    out = rows.select(*keys, F.inline(_array_of(parts)))
    if not options.hitsounds:
        return out
    sounds = rows.select("file", "time_ms", "at", "g", F.posexplode("sounds").alias("k", "s")).select("file", "time_ms", "at", "g", "k", "s.*")
    sounds = _as_of(sounds, points, F.col("t") + 5, ["sample_type", "volume"])
    field = sample_field(F.col("addition"), F.col("sample_type"), F.col("volume"))
    code = pack_hitsound(F.col("hitsound"), field["sample_set"], field["addition_set"])
    pair = [F.struct(F.lit(_PARTS["sound"]).alias("part"), (F.col("k") * 2 + i).alias("k"), kind(name).alias("type"), value.cast("long").alias("value")) for i, (name, value) in enumerate((("hitsound", code), ("volume", field["volume"])))]
    return out.unionByName(sounds.select(*keys, F.inline(F.array(*pair))))


def _plain(rows: DataFrame, snapped: bool) -> DataFrame:
    """Groups of a type and a time alone, from rows (file, at, type, time) and perhaps scroll and own_value."""
    sounds = F.array().cast("array<struct<t:double,hitsound:int,addition:string>>")
    rows = rows if "scroll" in rows.columns else rows.withColumn("scroll", F.lit(None).cast("double"))
    none = F.lit(None).cast("double")
    return rows.withColumns({
        "g": F.lit(0), "mode": F.lit(STANDARD), "columns": F.lit(0), "from_middle": F.lit(False), "has_time": F.lit(True), "x": none, "y": none,
        "combo": F.lit(False), "sounds": sounds, "snapped": F.lit(snapped),
    })


def events(objects: DataFrame, points: DataFrame, options: Options = Options()) -> DataFrame:
    """(file, place, time_ms, type, value): every chart's events, numbered from 0 in reading order.

    See groups() for `objects`; `points` are rows (file, seq, offset_ms, value, meter, sample_type, sample_set, volume,
    is_red, kiai). A group's events all have its time, cut to whole milliseconds. Events are in order of time; of equal
    times beats come first, then kiai changes, then scroll speed changes, then objects in their order. Types and combos
    have the value 0, kiai 0 or 1. Charts without timing points keep their groups without what points would tell.
    """
    lines = _points(points)
    rows = groups(objects, lines, options).withColumn("snapped", F.lit(True))
    out = _events_of(rows, lines, 3, options)
    w = ordered("file", "offset_ms", "seq2")
    sorted_points = points.withColumn("seq2", F.col("seq") * 2 + (~F.col("is_red")).cast("int"))
    ends = rows.groupBy("file").agg(F.max("time").alias("end"))
    if options.kiai:
        before = F.coalesce(F.lag("kiai").over(w), F.lit(False))
        turns = sorted_points.withColumn("was", before).where("kiai <> was")
        turns = turns.select("file", F.col("seq2").alias("at"), F.lit("kiai").alias("type"), F.col("offset_ms").cast("double").alias("time"), F.col("kiai").cast("int").alias("own_value"))
        out = out.unionByName(_events_of(_plain(turns, True), lines, 1, options))
    if options.timing:
        reds = points.where("is_red AND value > 0").join(ends, "file")
        grid = beat_grid(reds.select("file", "offset_ms", "value", "meter", "end"), "file", "offset_ms", "value", "meter", "end")
        kind = F.when((F.col("beat") == 0) & F.lit(options.timing_points), "timing_point").otherwise(F.col("kind"))
        beats = grid.select("file", F.col("beat").alias("at"), kind.alias("type"), F.col("time").cast("double").alias("time"))
        out = out.unionByName(_events_of(_plain(beats, False), lines, 0, options))
    if options.scroll_speeds:
        own = objects.select("file", "mode").distinct().where(F.col("mode") == COLUMNS) if "mode" in objects.columns else objects.select("file").limit(0)
        marked = sorted_points.join(own.select("file"), "file", "left_semi").join(ends, "file")
        if options.normalized:
            typical = dominant_period(marked.where("is_red"), "file", "offset_ms", "value", "end").withColumnRenamed("value", "typical")
            marked = marked.join(typical, "file")
        else:
            marked = marked.withColumn("value", F.when(F.col("is_red"), F.lit(1.0)).otherwise(F.col("value"))).withColumn("typical", F.lit(1.0))
        speeds = normalized_speeds(marked, "file", "offset_ms", "seq2", "is_red", "value", "typical")
        speeds = speeds.select("file", F.col("seq2").alias("at"), F.lit("scroll_speed_change").alias("type"), F.col("offset_ms").cast("double").alias("time"), F.col("speed").alias("scroll"))
        out = out.unionByName(_events_of(_plain(speeds, True), lines, 2, options))
    place = F.row_number().over(Window.partitionBy("file").orderBy("time_ms", "source", "at", "g", "part", "k")) - 1
    out = out.withColumn("place", place)
    if options.speed != 1.0:
        out = out.withColumn("value", F.when(F.col("type") == "time_shift", sped(F.col("value"), F.lit(options.speed))).otherwise(F.col("value")))
        out = out.withColumn("time_ms", sped(F.col("time_ms"), F.lit(options.speed)))
    return out.select("file", "place", "time_ms", "type", "value")
