"""Stateful streaming forms of batching, ordering and idleness. These are Spark-native extras: batch forms are in
cadence.operators.windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def packed_stream(requests: DataFrame, capacity: int) -> DataFrame:
    """(params, batch, seq, units) of a stream (params, seq, work): each key's requests fill numbered batches of
    `capacity` in order of arrival, split where a batch is full. State per key is one number, the work so far."""

    def pack(key, parts, state: GroupState):
        done = state.get[0] if state.exists else 0
        for rows in parts:
            out = []
            for seq, work in rows.sort_values("seq")[["seq", "work"]].itertuples(index=False):
                while work > 0:
                    units = min(work, capacity - done % capacity)
                    out.append((key[0], done // capacity, seq, units))
                    done, work = done + units, work - units
            yield pd.DataFrame(out, columns=["params", "batch", "seq", "units"])
        state.update((int(done),))

    return requests.groupBy("params").applyInPandasWithState(pack, "params string, batch long, seq long, units long", "done long", "append", GroupStateTimeout.NoTimeout)


def monotonic_stream(events: DataFrame) -> DataFrame:
    """Rows of a stream (key, seq, time_ms) whose time is not below the greatest one seen for the key."""

    def keep(key, parts, state: GroupState):
        high = state.get[0] if state.exists else None
        for rows in parts:
            rows = rows.sort_values("seq")
            before = rows["time_ms"].cummax().shift(fill_value=-(2**63))
            good = (rows["time_ms"] >= before) & (True if high is None else rows["time_ms"] >= high)
            high = max(int(rows["time_ms"].max()), high if high is not None else -(2**63)) if len(rows) else high
            yield rows[good][["key", "seq", "time_ms"]]
        if high is not None:
            state.update((high,))

    return events.groupBy("key").applyInPandasWithState(keep, "key string, seq long, time_ms long", "high long", "append", GroupStateTimeout.NoTimeout)


def idle_keys(events: DataFrame, idle_ms: int) -> DataFrame:
    """(key, last_ms) of keys of a stream (key, time_ms) once nothing came for them for `idle_ms` of processing time."""

    def watch(key, parts, state: GroupState):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], last)], columns=["key", "last_ms"])
            return
        last = state.get[0] if state.exists else 0
        for rows in parts:
            last = max(last, int(rows["time_ms"].max()))
        state.update((last,))
        state.setTimeoutDuration(idle_ms)

    return events.groupBy("key").applyInPandasWithState(watch, "key string, last_ms long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
