"""Keyed state that ends by itself: the history of a series and the life of a member.

Both keep Spark's RocksDB state per key and set timers on the processing clock, so what is silent goes without a new
row, and no clock in the data, ahead or behind, ends anything elsewhere.  Each emits changes; folding them by key gives
the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelag.model import SERIES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

HISTORY_CHANGES = "cluster string, topic string, part int, off bigint, at_ms bigint, kept boolean"
_SAMPLE = Row("cluster", "topic", "part", "off", "at_ms", "kept")
MEMBER_CHANGES = "member string, event string, first_seen_ms bigint, last_seen_ms bigint, seq bigint"
_CHANGE = Row("member", "event", "first_seen_ms", "last_seen_ms", "seq")


def use_rocksdb(spark) -> None:
    """The state store that keyed state needs; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _SeriesHistory(StatefulProcessor):
    """Retained samples of one series.  A sample that comes in or leaves is one change."""

    def __init__(self, ttl_ms: int, silence_ms: int):
        self.ttl_ms = ttl_ms
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getMapState("samples", "at_ms bigint", "off bigint")
        self.newest = handle.getValueState("newest", "at_ms bigint")
        self.due = handle.getValueState("due", "at_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        came: dict[int, int] = {}
        for r in rows:
            if r.off is not None and r.at_ms is not None:
                came[r.at_ms] = max(came.get(r.at_ms, r.off), r.off)
        if not came:
            return
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = max(came) if before is None else max(before, max(came))
        oldest = newest - self.ttl_ms
        if before is not None and newest > before:
            gone = [(at[0], off[0]) for at, off in self.samples.iterator() if at[0] < oldest]
            for at, off in gone:
                self.samples.removeKey((at,))
                yield _SAMPLE(*key, off, at, False)
        for at, off in sorted(came.items()):
            if at < oldest:
                continue
            known = self.samples.getValue((at,))[0] if self.samples.containsKey((at,)) else None
            if known is None or off > known:
                if known is not None:
                    yield _SAMPLE(*key, known, at, False)
                self.samples.updateValue((at,), (off,))
                yield _SAMPLE(*key, off, at, True)
        self.newest.update((newest,))
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((now + self.silence_ms,))
        self.handle.registerTimer(now + self.silence_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Nothing came for so long that the series is forgotten."""
        for at, off in [(at[0], off[0]) for at, off in self.samples.iterator()]:
            yield _SAMPLE(*key, off, at, False)
        self.samples.clear()
        self.newest.clear()
        self.due.clear()

    def close(self) -> None:
        pass


def history_stream(samples: DataFrame, ttl_seconds: int, silence_seconds: int | None = None) -> DataFrame:
    """Changes of the retained history of every series (update mode): the sample, and whether it is ``kept`` from now on.

    A sample is dropped ``ttl_seconds`` before the newest of its series, and all of a series once nothing came for
    ``silence_seconds`` (by default as long).  Folded, the changes equal ``history.retain`` over all samples.
    """
    silence = ttl_seconds if silence_seconds is None else silence_seconds
    return (
        samples.select(*SERIES, "off", "at_ms")
        .groupBy(*SERIES)
        .transformWithState(_SeriesHistory(ttl_seconds * 1000, silence * 1000), HISTORY_CHANGES, "Update", "ProcessingTime")
    )


def folded_history(changes: DataFrame) -> DataFrame:
    """The samples kept after all ``changes``: each comes in once for every time it leaves, or once more."""
    held = F.sum(F.when(F.col("kept"), 1).otherwise(-1)).alias("held")
    return changes.groupBy(*SERIES, "off", "at_ms").agg(held).where("held > 0").drop("held")


class _MemberLife(StatefulProcessor):
    """One member: joins with its first beat, leaves on request or once it has been silent too long."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "first bigint, last bigint, due bigint")
        self.count = handle.getValueState("count", "seq bigint")

    def _change(self, key: Any, event: str, first: int, last: int) -> Row:
        seq = self.count.get()[0] + 1 if self.count.exists() else 1
        self.count.update((seq,))
        return _CHANGE(key[0], event, first, last, seq)

    def _cancel(self) -> None:
        if self.life.exists():
            self.handle.deleteTimer(self.life.get()[2])
            self.life.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        # A leave follows a beat of the same time.
        for r in sorted(rows, key=lambda r: (r.at_ms, r.kind == "leave")):
            alive = self.life.get() if self.life.exists() else None
            if r.kind == "leave":
                if alive is not None and r.at_ms >= alive[0]:
                    self._cancel()
                    yield self._change(key, "left", alive[0], max(alive[1], r.at_ms))
                continue
            first = r.at_ms if alive is None else alive[0]
            last = r.at_ms if alive is None else max(alive[1], r.at_ms)
            self._cancel()
            self.life.update((first, last, now + self.ttl_ms))
            self.handle.registerTimer(now + self.ttl_ms)
            if alive is None:
                yield self._change(key, "joined", first, last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.life.exists():
            first, last, _ = self.life.get()
            self.life.clear()
            yield self._change(key, "evicted", first, last)

    def close(self) -> None:
        pass


def member_stream(events: DataFrame, ttl_seconds: float) -> DataFrame:
    """Members that join, leave or are evicted ``ttl_seconds`` after their last beat arrived (update mode).

    ``events``: member, kind (``beat`` or ``leave``), at_ms.  ``seq`` orders the changes of a member.
    """
    return (
        events.select("member", "kind", "at_ms")
        .groupBy("member")
        .transformWithState(_MemberLife(int(ttl_seconds * 1000)), MEMBER_CHANGES, "Update", "ProcessingTime")
    )


def live_after(changes: DataFrame) -> DataFrame:
    """member, first_seen_ms of the members alive after all ``changes``, as ``members.member_index`` takes them."""
    last = changes.groupBy("member").agg(F.max_by(F.struct("event", "first_seen_ms"), "seq").alias("last"))
    return last.where("last.event = 'joined'").select("member", "last.first_seen_ms")
