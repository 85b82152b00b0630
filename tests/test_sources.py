import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions import curves
from cadence.operators import chart_events
from cadence.sources import catalogue, charts, sinks

CHART = """file format v14

[General]
AudioFilename: a.mp3
Mode: 0

[Metadata]
Title:Small: one
BeatmapID:77

[TimingPoints]
0,500,4,2,1,60,1,0
1000,-50,4,2,1,40,0,1

[HitObjects]
256,92,0,5,0,0:0:0:0:
100,100,1000,2,2,L|200:100,2,140
256,192,3000,12,0,3500,0:0:0:0:
64,192,4000,128,0,4400:0:0:0:0:
"""


@pytest.fixture()
def chart(tmp_path):
    (tmp_path / "charts").mkdir()
    (tmp_path / "charts" / "one.txt").write_text(CHART)
    return str(tmp_path / "charts")


def test_chart_sections(spark, chart):
    rows = charts.lines(spark, chart)
    found = {(r.section, r.key): r.value for r in charts.settings(rows).collect()}
    assert found["Metadata", "Title"] == "Small: one" and found["General", "Mode"] == "0"
    points = charts.timing_points(rows).orderBy("seq").collect()
    assert [(p.offset_ms, p.value, p.is_red, p.kiai) for p in points] == [(0, 500.0, True, False), (1000, -50.0, False, True)]
    objects = charts.hit_objects(rows).orderBy("seq").collect()
    assert [(o.kind, o.time_ms, o.new_combo) for o in objects] == [("circle", 0, True), ("slider", 1000, False), ("spinner", 3000, True), ("hold", 4000, False)]


def of_chart(spark, chart, options=chart_events.Options(), **more):
    rows = charts.lines(spark, chart)
    objects = charts.hit_objects(rows)
    for name, value in more.items():
        objects = objects.withColumn(name, F.lit(value))
    return [(e.type, e.value, e.time_ms) for e in chart_events.events(objects, charts.timing_points(rows), options).orderBy("place").collect()]


def test_chart_events(spark, chart):
    """Worked by hand: 500 ms a beat from 0, from 1000 at twice the speed with volume 40 and kiai on."""
    found = of_chart(spark, chart)
    assert found == [
        # divisor 1 on the beat; (256, 92) is 100 from the middle; soft is 1 from sample type 2 -> 8 * 1 + 24 * 1
        ("time_shift", 0, 0), ("snapping", 1, 0), ("distance", 100, 0), ("pos_x", 256, 0), ("pos_y", 92, 0), ("new_combo", 0, 0), ("hitsound", 32, 0), ("volume", 60, 0), ("circle", 0, 0),
        ("time_shift", 1000, 1000), ("snapping", 1, 1000), ("distance", 156, 1000), ("pos_x", 100, 1000), ("pos_y", 100, 1000), ("hitsound", 32, 1000), ("volume", 40, 1000), ("slider_head", 0, 1000),
        # 140 long at twice the speed: 140 / (100 * 1.4 * 2) * 500 = 250 ms a span, two spans; the body has a whistle
        ("time_shift", 1250, 1250), ("snapping", 2, 1250), ("distance", 100, 1250), ("pos_x", 200, 1250), ("pos_y", 100, 1250),
        ("hitsound", 33, 1250), ("volume", 40, 1250), ("hitsound", 32, 1250), ("volume", 40, 1250), ("last_anchor", 0, 1250),
        # the line goes on to 240, 40 from its last control point
        ("time_shift", 1500, 1500), ("snapping", 1, 1500), ("distance", 40, 1500), ("pos_x", 240, 1500), ("pos_y", 100, 1500), ("hitsound", 32, 1500), ("volume", 40, 1500), ("slider_end", 0, 1500),
        ("time_shift", 3000, 3000), ("snapping", 1, 3000), ("spinner", 0, 3000),
        ("time_shift", 3500, 3500), ("snapping", 1, 3500), ("hitsound", 32, 3500), ("volume", 40, 3500), ("spinner_end", 0, 3500),
        ("time_shift", 4000, 4000), ("snapping", 1, 4000), ("distance", 192, 4000), ("pos_x", 64, 4000), ("pos_y", 192, 4000), ("hitsound", 32, 4000), ("volume", 40, 4000), ("hold_note", 0, 4000),
        ("time_shift", 4400, 4400), ("snapping", 5, 4400), ("distance", 0, 4400), ("pos_x", 64, 4400), ("pos_y", 192, 4400), ("hold_note_end", 0, 4400),
    ]


def test_chart_events_with_beats_and_kiai(spark, chart):
    plain = chart_events.Options(types_first=True, snapping=False, distances=False, positions=False, hitsounds=False, kiai=True, timing=True, timing_points=True, speed=2.0)
    found = of_chart(spark, chart, plain)
    assert found[:8] == [("timing_point", 0, 0), ("time_shift", 0, 0), ("circle", 0, 0), ("time_shift", 0, 0), ("new_combo", 0, 0), ("beat", 0, 250), ("time_shift", 250, 250), ("beat", 0, 500)]
    assert found[8:13] == [("time_shift", 500, 500), ("kiai", 1, 500), ("time_shift", 500, 500), ("slider_head", 0, 500), ("time_shift", 500, 500)]
    assert [e for e in found if e[0] == "measure"] == [("measure", 0, 1000), ("measure", 0, 2000)]


def test_chart_events_of_drums_and_columns(spark, chart):
    drums = of_chart(spark, chart, mode=1)
    assert [e[0] for e in drums if e[0].startswith(("drum", "den"))] == ["drumroll", "drumroll_end", "denden", "denden_end"]
    assert [e[1:] for e in drums if e[0] == "scroll_speed"] == [(100, 0), (200, 1000), (200, 3000)] and not any(e[0] in ("distance", "pos_x", "new_combo") for e in drums)
    columns = of_chart(spark, chart, chart_events.Options(scroll_speeds=True, normalized=False), mode=3, columns=4)
    assert [e[1:] for e in columns if e[0] == "mania_column"][:2] == [(2, 0), (0, 1000)]
    assert [e[1:] for e in columns if e[0] == "scroll_speed"] == [(100, 0), (200, 1000)]


def test_slider_anchors(spark):
    """Control points over one span of 100 ms; a point that comes twice is one red anchor."""
    lines = [("f", 1, "TimingPoints", "0,500,4,1,0,50,1,0"), ("f", 2, "HitObjects", "0,0,0,2,4,B|10:0|10:0|20:0|40:0,1,28,2|0,1:0|0:2"), ("f", 3, "HitObjects", "9,9,900,2,0,P|5:5|1:9,1,10")]
    rows = spark.createDataFrame(lines, "file string, line long, section string, text string")
    objects, points = charts.hit_objects(rows), charts.timing_points(rows)
    found = [(e.type, e.value, e.time_ms) for e in chart_events.events(objects, points, chart_events.Options(snapping=False, distances=False)).orderBy("place").collect()]
    assert [(k, t) for k, _, t in found if k.endswith("anchor")] == [("red_anchor", 25), ("bezier_anchor", 75), ("last_anchor", 100), ("perfect_anchor", 917), ("last_anchor", 935)]
    # head: whistle (2) of the normal set; end: additions of the soft set
    assert [v for k, v, t in found if k == "hitsound" and t in (0, 100)] == [1, 2, 24]
    second = chart_events.events(objects, points, chart_events.Options(snapping=False, distances=False, hitsounds=False, anchor_times=False)).orderBy("place").collect()
    assert [e.time_ms for e in second if e.type.endswith("anchor")] == [0, 0, 0, 100, 900, 900, 935]


def test_ends_of_curves():
    line = np.array([[0.0, 0], [10, 0]])
    assert [curves.at_length(line, x).tolist() for x in (0, 4, 10, 15)] == [[10, 0], [4, 0], [10, 0], [15, 0]]
    half = curves.flatten("P", np.array([[-100.0, 0], [0, 100], [100, 0]]))
    assert curves.at_length(half, 50 * np.pi) == pytest.approx([0, 100], abs=0.3)
    bow = np.array([[0.0, 0], [50, 200], [100, -200], [150, 0]])
    fine, coarse = curves.bezier(bow, 20_000), curves.flatten("B", bow)
    nearest = np.hypot(*(fine[:, None, :] - coarse[None, :, :]).transpose(2, 0, 1)).min(axis=0)
    assert nearest.max() < 0.02 and 10 < len(coarse) < 100
    middle = (coarse[1:] + coarse[:-1]) / 2
    assert np.hypot(*(fine[:, None, :] - middle[None, :, :]).transpose(2, 0, 1)).min(axis=0).max() < curves.TOLERANCE


def test_curves_of_a_high_degree():
    """As halving all the way down, which is exact but slow."""
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 300, (60, 2)).cumsum(axis=0) / 10
    t = np.linspace(0, 1, 9)
    want = np.repeat(points[None], 9, axis=0)
    while want.shape[1] > 1:
        want = want[:, :-1] * (1 - t[:, None, None]) + want[:, 1:] * t[:, None, None]
    assert np.allclose(curves.bezier(points, 8), want[:, 0], atol=1e-8)
    far = np.column_stack([np.arange(1500.0), np.zeros(1500)])
    assert np.allclose(curves.flatten("B", far)[-1], [1499, 0]) and np.allclose(curves.at_length(curves.flatten("B", far), 700), [700, 0])


def test_header_field(spark, chart):
    assert catalogue.header_field(spark, chart, "BeatmapID").first().value == "77"


def test_track_json(spark, tmp_path):
    chart = {"BeatmapId": 5, "CircleSize": 4.0, "StandardStarRating": {"0": 3.5, "64": 5.0}}
    (tmp_path / "metadata.json").write_text(json.dumps({"BeatmapSetId": 1, "Artist": "A", "Beatmaps": {"Hard": chart}}, indent=1))
    row = catalogue.flat_charts(catalogue.tracks(spark, str(tmp_path))).first()
    assert (row.Version, row.BeatmapId, row.Stars, row.StarsFast) == ("Hard", 5, 3.5, 5.0)


def test_side_tables(spark, tmp_path):
    (tmp_path / "w.csv").write_text("1,0.5\n2,1.5\n")
    (tmp_path / "ids.txt").write_text("3\n\n x\n 4 \n")
    (tmp_path / "m.json").write_text('[{"id": 1, "user_id": 9, "username": ["u", "v"]}]')
    assert catalogue.weights(spark, str(tmp_path / "w.csv")).count() == 2
    assert sorted(r.id for r in catalogue.ids(spark, str(tmp_path / "ids.txt")).collect()) == [3, 4]
    assert catalogue.mappers(spark, str(tmp_path / "m.json")).first().username == ["u", "v"]


def test_metric_log(spark, tmp_path):
    (tmp_path / "run.log").write_text("FID: 12.5\nnoise\nFID: 11.0\nActive F1: 0.5\n")
    rows = catalogue.metric_log(spark, str(tmp_path), ["FID", "Active F1"]).orderBy("line").collect()
    assert [(r.metric, r.value) for r in rows] == [("FID", 12.5), ("FID", 11.0), ("Active F1", 0.5)]


def test_numbered_files(spark, tmp_path):
    for n in (1, 2, 3):
        (tmp_path / f"Track{n:05d}").mkdir()
        (tmp_path / f"Track{n:05d}" / "c.txt").write_text("x")
    assert sorted(r.track for r in catalogue.numbered_files(spark, f"{tmp_path}/Track*/*", 2, 4).collect()) == [2, 3]


def test_replace_path_being_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    sinks.replace_parquet(spark.read.parquet(path).where("id < 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_commits_replace_a_table_that_is_being_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        sinks.committed(spark, path)
    sinks.commit(spark.range(5), path)
    old = sinks.committed(spark, path)
    sinks.commit(old.where("id < 2"), path)
    assert sinks.committed(spark, path).count() == 2
    assert old.count() == 5  # whoever began with the version before can still read it
    sinks.commit(spark.range(0), path)
    assert sinks.committed(spark, path).count() == 0
    assert len(list(tmp_path.glob("t/v-*"))) == 2


def test_a_writer_lost_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    sinks.commit(spark.range(5), path)
    spark.range(9).write.parquet(f"{path}/v-lost")  # written whole, but never named
    assert sinks.committed(spark, path).count() == 5
    failing = spark.range(3).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.commit(failing, path)
    assert sinks.committed(spark, path).count() == 5
    before = sinks.committed(spark, path)
    sinks.commit(spark.range(7), path)
    assert sinks.committed(spark, path).count() == 7 and before.count() == 5
    assert not (tmp_path / "t" / "v-lost").exists()


def test_render_and_names(spark):
    header = spark.createDataFrame([(1, "[General]\nMode: 0")], "k long, header string")
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k long, seq long, text string")
    text = sinks.chart_text(header, lines, lines.limit(0), "k").first().value
    assert "[TimingPoints]\na\nb\n" in text and text.endswith("[HitObjects]\n")
    names = spark.createDataFrame([("a.txt", 1), ("a.txt", 2), ("b", 3)], "name string, n long")
    assert sorted(r.name for r in sinks.unique_names(names, "name", "n").collect()) == ["a (1).txt", "a.txt", "b"]
    assert sinks.html_rows(spark.createDataFrame([("<x>", 1)], "a string, b long"), ["a", "b"]).first().value == "<tr><td>&lt;x></td><td>1</td></tr>"


def test_assembly(spark):
    from cadence.operators import assembly

    g = lambda seq, kind, time, x=None, y=None, combo=False: (1, seq, kind, time, x, y, combo, 0, None, None)
    rows = [
        g(0, "circle", 10, 5.0, 6.0, True), g(1, "hold", 20, 64.0), g(2, "hold_end", 40), g(3, "hold_end", 50), g(4, "spinner", 60), g(5, "spinner_end", 90),
        g(6, "slider_head", 100, 10.0, 20.0), g(7, "perfect_anchor", 100, 30.0, 40.0), g(8, "red_anchor", 110, 1.0, 2.0), g(9, "last_anchor", 200, 50.0, 60.0),
        g(10, "slider_end", 300, 50.0, 60.0), g(11, "slider_head", 400, 1.0, 1.0), g(12, "slider_end", 500),
    ]
    schema = "chart long, seq long, type string, time long, x double, y double, new_combo boolean, hitsound int, sample_set int, addition int"
    got = [r.text for r in assembly.hit_object_lines(spark.createDataFrame(rows, schema)).orderBy("seq").collect()]
    assert got == [
        "5,6,10,5,0,0:0:0:0:", "64,192,20,128,0,40:0:0:0:0:", "256,192,60,12,0,90,0:0:0:0:", "10,20,100,2,0,P|30:40|1:2|1:2|50:60,2,100,0:0:0:0:"
    ]


def test_work_is_dropped(spark):
    from cadence import session

    df = session.written(spark.range(3).toDF("id"), "here")
    path = session._MADE[-1]
    assert df.count() == 3
    session.drop_work(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_slider_keeps_all_anchors(spark):
    curve = "|".join(["B", *(f"{i}:0" for i in range(1500))])
    lines = [("f", 1, "TimingPoints", "0,500,4,1,0,50,1,0"), ("f", 2, "HitObjects", f"100,100,0,2,0,{curve},1,140")]
    rows = spark.createDataFrame(lines, "file string, line long, section string, text string")
    found = chart_events.events(charts.hit_objects(rows), charts.timing_points(rows), chart_events.Options(most_points=None))
    assert [e.value for e in found.where("type = 'pos_x'").orderBy("place").collect()][:1500] == [100, *(min(i, 768) for i in range(1499))]
    assert chart_events.events(charts.hit_objects(rows), charts.timing_points(rows)).count() == 0


def chart_folder(tmp_path):
    body = "﻿format v14\r\n\r\n[General]\r\nMode: 3\r\n// no\r\n[Metadata]\r\nTitle:é%d\r\n\r\n[HitObjects]\r\n" + "1,2,3,1,0\r\n" * 50_000
    for i in range(12):
        (tmp_path / f"set{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"set{i % 3}" / f"{i}.txt").write_bytes((body % i).encode())
    (tmp_path / "set0" / "empty.txt").write_bytes(b"")
    (tmp_path / "set0" / ".hidden.txt").write_bytes(b"[Metadata]\nx:y\n")
    (tmp_path / "set0" / "other.bin").write_bytes(b"[Metadata]\nx:y\n")
    (tmp_path / "set0" / "twice.txt").write_bytes(b"lead\n[Metadata]\na:1\n[General]\nb:2\n[Metadata]\na:2\nbad \xff\n[Last]\nend")
    return f"file://{tmp_path}"


def test_chart_source_pushes_sections_and_files(spark, tmp_path):
    from cadence.sources.chart_source import read_charts

    lines = read_charts(spark, chart_folder(tmp_path), partitionBytes="1200000")
    titles = lines.where("section = 'Metadata'")
    assert sorted(r.text for r in titles.collect()) == sorted(["a:1", *(f"Title:é{i}" for i in range(12))])
    plan = titles._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(section" in plan and "(section#" not in plan.replace("isnotnull(section", "")  # equality is left to the reader
    some = lines.where("section IN ('General', 'Last') AND file LIKE '%/set0/%'").collect()
    assert sorted((r.text, r.line) for r in some) == sorted([("b:2", 4), ("end", 9), *[("Mode: 3", 3)] * 4])
    assert lines.where("section IS NULL").collect()[0].text in ("lead", "format v14")
    assert lines.where("file LIKE '%twice.txt' AND section = 'Last' AND section = 'General'").count() == 0
    assert lines.where("section = 'HitObjects'").count() == 600_000
    assert lines.rdd.getNumPartitions() == 6


def test_chart_source_reads_no_more_than_it_must(tmp_path):
    """Bytes taken from files with and without a filter, and files opened."""
    from pyspark.sql.datasource import EqualTo, In, StringEndsWith

    from cadence.sources import chart_source

    class Counted:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def read(self, n):
            data = self.file.read(n)
            self.bytes += len(data)
            return data

    chart_folder(tmp_path)
    path = tmp_path / "set1" / "1.txt"

    def taken(*filters):
        reader = chart_source.ChartReader({"path": str(tmp_path)})
        left = list(reader.pushFilters(list(filters)))
        with path.open("rb") as file:
            counted = Counted(file)
            return len(list(reader.lines(counted))), counted.bytes, left, sum(len(p.names) for p in reader.partitions())

    assert taken() == (50_003, path.stat().st_size, [], 14)
    assert taken(EqualTo(("section",), "Metadata")) == (1, chart_source.PART, [], 14)
    assert taken(In(("section",), ("General", "Metadata")), StringEndsWith(("file",), "/1.txt")) == (2, chart_source.PART, [], 1)
    other = EqualTo(("text",), "x")
    assert taken(other)[2] == [other]


def test_chart_files_are_packed_by_bytes():
    from cadence.sources.chart_source import packed

    assert packed([("a", 5), ("b", 5), ("c", 1), ("d", 50), ("e", 1)], 12, 1) == [["a", "b"], ["c"], ["d"], ["e"]]
    groups = packed(((str(i), 100) for i in range(10_000)), 10_000, 100)
    assert [len(g) for g in groups] == [50] * 200 and packed([], 1, 1) == []


def test_charts_are_written_whole_and_read_back(spark, tmp_path):
    from cadence.sources.chart_source import read_charts, write_charts

    rows = [(i, f"[Metadata]\nTitle:{i}\n" + "x\n" * (i % 5)) for i in range(200)] + [(200, None)]
    written = write_charts(spark.createDataFrame(rows, "chart long, value string").repartition(3), f"file://{tmp_path}/charts", "chart")
    assert {r.key for r in written.collect()} == set(range(201)) and len(list((tmp_path / "charts").iterdir())) <= 4
    lines = read_charts(spark, f"file://{tmp_path}/charts").where("section = 'Metadata'").collect()
    assert sorted(r.text for r in lines if r.text.startswith("Title")) == sorted(f"Title:{i}" for i in range(200)) and len(lines) == 200 + 400
    assert not [p for p in (tmp_path / "charts").rglob(".*") if not p.name.endswith(".crc")]
