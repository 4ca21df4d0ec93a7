"""Streams with keyed state and timers: coalesced progress, and claims of queued jobs.

Both hold what has come until the watermark says that nothing earlier will, and decide then, so that the answer does not
depend on how the events were cut into batches: late ones within the watermark count, repeated ones count once, and a
restart goes on from the checkpoint. They need a state store that keeps timers (rocksdb_state()).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

#: Progress of one job within so many milliseconds is one event.
SLOT_MS = 300
PROGRESS = "progress"
OUT = "job string, seq long, kind string, value double, ts timestamp"


def rocksdb_state(spark: SparkSession) -> None:
    """Sets the state store of new queries of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _texts(values: Any) -> pd.Series:
    return pd.Series(list(values), dtype=object)


class _Coalesce(StatefulProcessor):
    """Per job: events by sequence number until their slot is over."""

    def __init__(self, slot_ms: int) -> None:
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "kind string, value double, millis long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for seq, kind, value, ts in zip(pdf["seq"], pdf["kind"], pdf["value"], pdf["ts"], strict=True):
                at = _millis(ts)
                self.waiting.updateValue((int(seq),), (kind, None if pd.isna(value) else float(value), at))
                # When its slot has passed the watermark nothing of it can come any more.
                self.handle.registerTimer((at // self.slot_ms + 1) * self.slot_ms)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k[0], *v) for k, v in self.waiting.iterator() if v[2] < end)
        for seq, *_ in ready:
            self.waiting.removeKey((seq,))
        # The last progress before another event, or at the end of the slot.
        kept = [r for r, after in zip(ready, [*ready[1:], None], strict=True) if r[1] != PROGRESS or after is None or after[1] != PROGRESS]
        if kept:
            yield pd.DataFrame({"job": _texts([key[0]] * len(kept)), "seq": [r[0] for r in kept], "kind": _texts([r[1] for r in kept]), "value": [r[2] for r in kept], "ts": pd.to_datetime([r[3] for r in kept], unit="ms")})

    def close(self) -> None:
        pass


def coalesced(events: DataFrame, late: str = "10 seconds", slot_ms: int = SLOT_MS) -> DataFrame:
    """A stream of events (job, seq, kind, value, ts) with progress coalesced: of a job's progress in one slot only the last before another event is left.

    seq numbers a job's events and ascends with ts. Other events all stay, in order. Events older than the watermark are dropped.
    """
    ship(events.sparkSession)
    rows = events.select(F.col("job").cast("string").alias("job"), F.col("seq").cast("long").alias("seq"), "kind", F.col("value").cast("double").alias("value"), "ts").withWatermark("ts", late)
    return rows.groupBy("job").transformWithStateInPandas(statefulProcessor=_Coalesce(slot_ms), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def coalesced_batch(events: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """The same of a whole table, by windows."""
    rows = events.dropDuplicates(["job", "seq"]).withColumn("__slot", F.floor(F.unix_millis("ts") / slot_ms))
    after = F.lead("kind").over(Window.partitionBy("job", "__slot").orderBy("seq"))
    return rows.withColumn("__after", after).where((F.col("kind") != PROGRESS) | F.coalesce(F.col("__after") != PROGRESS, F.lit(True))).select("job", "seq", "kind", "value", "ts")


class _Claims(StatefulProcessor):
    """Per queue: jobs that wait, by priority and time, and what runs until when."""

    def __init__(self, tick_ms: int, alone: tuple[str, ...]) -> None:
        self.tick_ms, self.alone = tick_ms, alone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "job string", "owner string, kind string, priority int, millis long, takes long")
        self.running = handle.getMapState("running", "job string", "owner string, kind string, until long")
        self.clock = handle.getValueState("clock", "millis long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                at = _millis(r.ts)
                self.waiting.updateValue((r.job,), (r.owner, r.kind, int(r.priority), at, int(r.takes_ms)))
                self.handle.registerTimer((at // self.tick_ms + 1) * self.tick_ms)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, final = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        # The first timer of a batch goes through all ticks that are final by now.
        if self.clock.exists() and now <= self.clock.get()[0]:
            return
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        busy = {k[0]: tuple(v) for k, v in self.running.iterator()}
        claimed: list[tuple] = []
        while now is not None and now <= final:
            self.clock.update((now,))
            for k in [k for k, v in busy.items() if v[2] <= now]:
                self.running.removeKey((k,))
                del busy[k]
            claimed += self._start(now, waiting, busy)
            now = self._next(now, waiting, busy)
        if now is not None:
            self.handle.registerTimer(now)
        if claimed:
            job, owner, kind, at = zip(*claimed, strict=True)
            yield pd.DataFrame({"queue": _texts([key[0]] * len(job)), "job": _texts(job), "owner": _texts(owner), "kind": _texts(kind), "at": pd.to_datetime(list(at), unit="ms")})

    def _start(self, now: int, waiting: dict, busy: dict) -> Iterator[tuple]:
        for k, (owner, kind, _, at, takes) in sorted(waiting.items(), key=lambda x: (x[1][2], x[1][3], x[0])):
            if at >= now or any(b[0] == owner for b in busy.values()):
                continue
            # A job of an exclusive kind waits for all others, and nothing overtakes it or runs beside it.
            if busy and (kind in self.alone or any(b[1] in self.alone for b in busy.values())):
                break
            busy[k] = (owner, kind, now + takes)
            self.running.updateValue((k,), busy[k])
            self.waiting.removeKey((k,))
            del waiting[k]
            yield k, owner, kind, now

    def _next(self, now: int, waiting: dict, busy: dict) -> int | None:
        """The next tick at which a job may start: one that comes, or the end of one that runs."""
        if not waiting:
            return None
        times = [v[3] + 1 for v in waiting.values() if v[3] >= now] + [b[2] for b in busy.values()]
        return (max(now, min(times) - 1) // self.tick_ms + 1) * self.tick_ms if times else None

    def close(self) -> None:
        pass


def claims(jobs: DataFrame, late: str = "10 seconds", tick_ms: int = 1000, alone: tuple[str, ...] = ()) -> DataFrame:
    """A stream (queue, job, owner, kind, at) of the jobs that a queue starts at each tick.

    jobs: (queue, job, owner, kind, priority, takes_ms, ts). The least priority first, then the oldest; an owner has one job
    running at a time, and its others are passed over. Kinds of `alone` run with nothing beside them, and nothing overtakes
    them. A job runs for takes_ms.
    """
    ship(jobs.sparkSession)
    rows = jobs.select("queue", "job", "owner", "kind", "priority", "takes_ms", "ts").withWatermark("ts", late)
    return rows.groupBy("queue").transformWithStateInPandas(statefulProcessor=_Claims(tick_ms, alone), outputStructType="queue string, job string, owner string, kind string, at timestamp", outputMode="append", timeMode="EventTime")
