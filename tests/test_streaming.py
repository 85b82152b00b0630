import random

import pytest

from cadence.streaming import server, stateful


def run(spark, tmp_path, rows, schema, build, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_requests_fill_batches(spark, tmp_path):
    rows = [("a", 1, 3), ("a", 2, 4), ("b", 1, 2)]
    found = run(spark, tmp_path, rows, "params string, seq long, work long", lambda s: stateful.packed_stream(s, 5), "packed")
    assert sorted(map(tuple, found)) == [("a", 0, 1, 3), ("a", 0, 2, 2), ("a", 1, 2, 2), ("b", 0, 1, 2)]


def test_times_do_not_go_back(spark, tmp_path):
    rows = [("a", 1, 10), ("a", 2, 5), ("a", 3, 10), ("b", 1, 1)]
    found = run(spark, tmp_path, rows, "key string, seq long, time_ms long", stateful.monotonic_stream, "monotonic")
    assert sorted((r.key, r.seq) for r in found) == [("a", 1), ("a", 3), ("b", 1)]


def test_idle_keys_are_told_once(spark, tmp_path):
    import time

    schema = "key string, time_ms long"
    spark.createDataFrame([("a", 1), ("a", 7), ("b", 3)], schema).write.parquet(f"{tmp_path}/in")
    stream = stateful.idle_keys(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1000)
    query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("idle").count() < 2:
            time.sleep(0.5)
        time.sleep(2)
        assert sorted(map(tuple, spark.table("idle").collect())) == [("a", 7), ("b", 3)]
    finally:
        query.stop()


def requests_of(rng, n, keys="abc"):
    at, rows = 0, []
    for seq in range(n):
        at += rng.choice([0, 1, 5, 40, 400])
        rows.append((rng.choice(keys), seq, rng.choice([0, 1, 3, 9, 25]), at))
    return rows


def plain_batches(rows, capacity, wait):
    """A key's requests one by one; the watermark ends at the latest request of all."""
    out, mark = [], max(r[3] for r in rows)
    for key in sorted({r[0] for r in rows}):
        held, batch = [], 0

        def close(full, at):
            nonlocal held, batch
            out.extend((key, batch, seq, units, full, at) for seq, units, _ in held)
            held, batch = [], batch + 1

        for _, seq, units, at in sorted((r for r in rows if r[0] == key and r[2] > 0), key=lambda r: (r[3], r[1])):
            if held and at >= held[0][2] + wait:
                close(False, held[0][2] + wait)
            for _ in range(units):
                if held and held[-1][0] == seq:
                    held[-1] = (seq, held[-1][1] + 1, at)
                else:
                    held.append((seq, 1, at))
                if sum(h[1] for h in held) == capacity:
                    close(True, at)
        if held and held[0][2] + wait <= mark:
            close(False, held[0][2] + wait)
    return sorted(out)


def plain_spans(rows, idle):
    out, mark = [], max(r[3] for r in rows)
    for key in {r[0] for r in rows}:
        span = None
        for at in sorted(r[3] for r in rows if r[0] == key):
            if span and at >= span[1] + idle:
                out.append((key, *span, span[1] + idle))
                span = None
            span = (span[0], at, span[2] + 1) if span else (at, at, 1)
        if span[1] + idle <= mark:
            out.append((key, *span, span[1] + idle))
    return sorted(out)


def fed(spark, folder, rows, name):
    """The rows as one file more of a folder that a stream reads."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "key string, seq long, units long, ms long").withColumn("at", F.timestamp_millis("ms"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/part={name}")


def stream_of(spark, folder):
    rows = spark.readStream.schema("key string, seq long, units long, ms long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    return rows.withColumnRenamed("key", "params"), rows.select("key", "at")


@pytest.mark.parametrize("cuts", [[], [50], [20, 21, 60]])
def test_server_streams_stopped_and_started_again(spark, tmp_path, cuts):
    """Whatever the micro-batches and restarts, the rows are those of a plain version over all requests."""
    rows = requests_of(random.Random(len(cuts)), 80)
    ends = [*cuts, len(rows)]
    for start, end in zip([0, *cuts], ends, strict=True):
        fed(spark, f"{tmp_path}/in", rows[start:end], end)
        spark.conf.set(*server.PROVIDER)  # each of the two streams goes on from its checkpoint
        requests, activity = stream_of(spark, f"{tmp_path}/in")
        batches = server.run_once(server.batched(requests, 16, 300, "at"), f"{tmp_path}/batches", f"{tmp_path}/batching")
        spans = server.run_once(server.idle(activity, 300, "at"), f"{tmp_path}/spans", f"{tmp_path}/idling")
    assert sorted(map(tuple, batches.collect())) == plain_batches(rows, 16, 300)
    assert sorted(map(tuple, spans.collect())) == plain_spans(rows, 300)


def test_server_takes_requests_as_they_come(spark, tmp_path):
    """A processing-time trigger; the stream is stopped half way and started again from its checkpoint."""
    import time

    rows = requests_of(random.Random(9), 60)
    spark.conf.set(*server.PROVIDER)
    expected = plain_batches(rows, 8, 200)
    for half in (rows[:30], rows[30:]):
        fed(spark, f"{tmp_path}/in", half, half[0][1])
        stream = server.batched(stream_of(spark, f"{tmp_path}/in")[0], 8, 200, "at")
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
            until = time.time() + 60
            while half[-1] == rows[-1] and time.time() < until and spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").count() < len(expected):
                time.sleep(0.5)
        finally:
            query.stop()
    assert sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())) == expected
