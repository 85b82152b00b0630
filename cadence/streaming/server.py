"""A batching server's queue and idleness as stateful streams.

Requests wait in a list state of their key until they fill a batch or the oldest has waited long enough; timers tell
both streams when time has passed, and are moved as activity goes on. Times are event times: what comes out depends on
the requests alone, not on how micro-batches cut them, so a stream that is stopped and started again from its checkpoint
gives the same rows.

Rows of a key are taken in order of time and seq within a micro-batch; from one micro-batch to the next, as well as the
watermark's delay allows: rows later than the watermark are dropped by Spark. A trigger's size bounds what a key holds
at once (maxFilesPerTrigger, maxBytesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that transformWithState needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
BATCHES = "params string, batch long, seq long, units long, full boolean, closed_ms long"
IDLE = "key string, first_ms long, last_ms long, n long, idle_ms long"


class _Queue(StatefulProcessor):
    """Pending (seq, units, at_ms) of a key, oldest first, and the number of its next batch."""

    def __init__(self, capacity: int, wait_ms: int):
        self.capacity, self.wait_ms = capacity, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "seq long, units long, at_ms long")
        self.next = handle.getValueState("next", "batch long, timer long")

    def _close(self, key, batch: int, rows: list[tuple], full: bool, at: int) -> list[tuple]:
        return [(key[0], batch, seq, units, full, at) for seq, units, _ in rows]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.pending.get()]
        batch, timer = self.next.get() if self.next.exists() else (0, None)
        filled, out = sum(r[1] for r in held), []
        got = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        for seq, units, at in zip(got["seq"].tolist(), got["units"].tolist(), got["at_ms"].tolist(), strict=True):
            if held and at >= held[0][2] + self.wait_ms:
                out += self._close(key, batch, held, False, held[0][2] + self.wait_ms)
                held, filled, batch = [], 0, batch + 1
            while units > 0:
                part = min(units, self.capacity - filled)
                held.append((seq, part, at))
                filled, units = filled + part, units - part
                if filled == self.capacity:
                    out += self._close(key, batch, held, True, at)
                    held, filled, batch = [], 0, batch + 1
        self._keep(held, batch, timer)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in BATCHES.split(", ")])

    def _keep(self, held: list[tuple], batch: int, timer: int | None) -> None:
        due = held[0][2] + self.wait_ms if held else None
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if held:
            self.pending.put(held)
        else:
            self.pending.clear()
        self.next.update((batch, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, (batch, _) = [tuple(r) for r in self.pending.get()], self.next.get()
        out = self._close(key, batch, held, False, expiredTimerInfo.getExpiryTimeInMs())
        self.pending.clear()
        self.next.update((batch + (1 if held else 0), None))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in BATCHES.split(", ")])

    def close(self) -> None:
        pass


def batched(requests: DataFrame, capacity: int, wait_ms: int, time: str, delay: str = "0 seconds") -> DataFrame:
    """A stream of BATCHES from one of requests (params, seq, units, and a timestamp column `time`).

    A key's requests fill batches of `capacity` units in order of time and seq; a request that doesn't fit is split. A
    batch is closed when it is full, or `wait_ms` after its oldest request came, by a later request of the key or once
    the watermark (`delay` behind the latest request of all) has passed that time. Requests without units make no row.
    """
    rows = requests.withWatermark(time, delay).select("params", "seq", "units", F.expr(f"unix_millis({time})").alias("at_ms"), time).where("units > 0")
    return rows.groupBy("params").transformWithStateInPandas(_Queue(capacity, wait_ms), BATCHES, "Append", "EventTime")


class _Activity(StatefulProcessor):
    """A key's span of activity: its first and last time and number of events."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first long, last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, n = self.span.get() if self.span.exists() else (None, None, 0)
        before, out = last, []
        for at in sorted(pd.concat(list(rows))["at_ms"].tolist()):
            if last is not None and at >= last + self.idle_ms:
                out.append((key[0], first, last, n, last + self.idle_ms))
                first, n = None, 0
            first, last, n = at if first is None else first, at if last is None else max(at, last), n + 1
        if before is not None:
            self.handle.deleteTimer(before + self.idle_ms)
        self.handle.registerTimer(last + self.idle_ms)
        self.span.update((first, last, n))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in IDLE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, n = self.span.get()
        self.span.clear()
        yield pd.DataFrame([(key[0], first, last, n, expiredTimerInfo.getExpiryTimeInMs())], columns=[f.split()[0] for f in IDLE.split(", ")])

    def close(self) -> None:
        pass


def idle(events: DataFrame, idle_ms: int, time: str, delay: str = "0 seconds") -> DataFrame:
    """A stream of IDLE, a row for each span of a key's activity that ended: no event came for `idle_ms` after its last.

    From a stream (key, and a timestamp column `time`). A key's timer is moved by each event; when the watermark passes
    it, the key's state goes, and a later event starts a new span.
    """
    rows = events.withWatermark(time, delay).select("key", F.expr(f"unix_millis({time})").alias("at_ms"), time)
    return rows.groupBy("key").transformWithStateInPandas(_Activity(idle_ms), IDLE, "Append", "EventTime")


def run_once(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> DataFrame:
    """All that is there, to files in `folder`; the sink's log and the checkpoint make each row appear once, however often
    the stream is stopped and started. Returns what the folder holds."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set(*PROVIDER)
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
