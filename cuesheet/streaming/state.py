"""Progress as streams with state: snapshots that expire, silence, and subscribers who join late.

Event time decides throughout, so a replay gives what the live stream gave. What comes later than the watermark is dropped; ``late`` of
``progress.event_stream`` is how long it waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import progress

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SNAPSHOT = "stage string, value double, ts timestamp, event_id long"


class _Snapshot(StatefulProcessor):
    """A task's last event, in a value state that a timer clears ``kept_ms`` after it."""

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", SNAPSHOT)

    def _ends(self, ts: pd.Timestamp) -> int:
        """When a snapshot of this time expires, in whole milliseconds, as timers count."""
        return -(-(pd.Timestamp(ts).value // 1000) // 1000) + self.kept_ms

    def _expired(self, key, last) -> dict:
        stage, value, ts, _ = last
        return {"task": key[0], "stage": stage, "value": value, "ts": ts, "expired": pd.Timestamp(ts) + pd.Timedelta(milliseconds=self.kept_ms)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = (self.last.get() if self.last.exists() else None), []
        before = last
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # one task's events of a batch
        for stage, value, ts, event_id in zip(new["stage"], new["value"], new["ts"], new["event_id"]):
            if last is not None and (pd.Timestamp(ts), event_id) <= (pd.Timestamp(last[2]), last[3]):
                continue  # it came late: what is known is newer
            if last is not None and pd.Timestamp(ts) - pd.Timestamp(last[2]) > pd.Timedelta(milliseconds=self.kept_ms):
                out.append(self._expired(key, last))
            last = (stage, float(value), pd.Timestamp(ts).to_pydatetime(), int(event_id))
        if last is not before:
            if before is not None:
                self.handle.deleteTimer(self._ends(before[2]))
            self.last.update(last)
            self.handle.registerTimer(self._ends(last[2]))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = self.last.get()
            self.last.clear()
            yield pd.DataFrame([self._expired(key, last)])

    def close(self) -> None:
        pass


def expiries(stream: DataFrame, kept_hours: float = 24.0) -> DataFrame:
    """(task, stage, value, ts, expired): each snapshot that was not replaced within ``kept_hours``, when its time has passed.

    stream: (task, stage, value, ts, event_id) with a watermark. The state is one row a task, cleared when its snapshot expires, so tasks
    that are never heard again leave nothing behind. It needs the session's state store to be STORE.
    """
    kind = f"task {stream.schema['task'].dataType.simpleString()}, stage string, value double, ts timestamp, expired timestamp"
    rows = stream.select("task", "stage", "value", "ts", "event_id")
    return rows.groupBy("task").transformWithStateInPandas(_Snapshot(int(kept_hours * 3_600_000)), kind, "Append", "EventTime")


def closed_silences(stream: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Sessions of a task's events, each once: when the watermark has passed its last event by ``gap``."""
    return progress.silence_sessions(stream, gap)


def once(stream: DataFrame) -> DataFrame:
    """Events of a stream with a watermark without those that come again within it, by event_id; their state goes with it."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def subscribed(events: DataFrame, joins: DataFrame, kept: str = progress.KEPT, longest: str = "30 days") -> DataFrame:
    """What may concern subscribers: each join (subscriber, task, joined) with its task's events from ``kept`` before to ``longest`` after it.

    Both are streams with watermarks; the interval bounds how long either side waits in the state.
    """
    j = joins.select(F.col("task").alias("_task"), "subscriber", "joined")
    on = F.expr(f"task = _task AND ts > joined - INTERVAL {kept} AND ts <= joined + INTERVAL {longest}")
    return events.join(j, on, "inner").select("subscriber", "task", "joined", "ts", "event_id", "stage", "value")


def delivered(table: DataFrame, ended: tuple[str, ...] = progress.ENDED) -> DataFrame:
    """What subscribers get, from the table that ``subscribed`` writes: the last event before they joined, later ones, up to an end."""
    return progress.deliveries(table, ended)

