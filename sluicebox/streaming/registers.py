"""Versioned drafts and the grace race as keyed state of a stream.

Needs Spark's RocksDB state store (STATE_STORE).  Both are the twins of batch
functions in decisions.py: draft_updates and grace.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GRACE_MS = 300
#: How long (event time) a decided race is remembered, so that what comes late is not taken for a new one.
REMEMBER_MS = 3600 * 1000


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Drafts(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.register = handle.getValueState("register", "version long, frozen boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, frozen = self.register.get() or (0, False)
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["kind"] == "freeze":
                frozen, result = True, "frozen"
            elif frozen:
                result = "refused-frozen"
            elif 0 < (r["expected"] or 0) < version:
                result = "refused-stale"
            else:
                version, result = version + 1, "accepted"
            yield Row(draft_id=key[0], seq=r["seq"], result=result, version=version)
        self.register.update((version, frozen))

    def close(self) -> None: ...


def draft_updates(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """What becomes of each update of a stream (draft_id, seq, kind, text, expected): see decisions.draft_updates.

    With ``ttl_ms`` a draft that nobody touches for so long is forgotten.  Spark
    then runs batches without data as well, so such a query runs until stopped
    (with the trigger availableNow too).
    """
    use_state_store(rows.sparkSession)
    needed = rows.select("draft_id", "seq", "kind", "expected")
    return needed.groupBy("draft_id").transformWithState(_Drafts(ttl_ms), "draft_id long, seq long, result string, version long", "Append", "ProcessingTime" if ttl_ms else "None")


class _Race(StatefulProcessor):
    """The first times (ms) of a decision and of the poll's end, until the time at which no earlier row can come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "decided long, polled long, winner string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        decided, polled, winner = self.seen.get() or (None, None, None)
        if winner is None:
            for r in rows:
                if r["event"] == "decision":
                    decided = r["ms"] if decided is None else min(decided, r["ms"])
                else:
                    polled = r["ms"] if polled is None else min(polled, r["ms"])
            self.seen.update((decided, polled, winner))
            for at in {decided, None if polled is None else polled + GRACE_MS} - {None}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        decided, polled, winner = self.seen.get() or (None, None, None)
        if winner is not None:
            # Timers of rows that no longer count fire too; the last one is the one to forget by.
            if expiredTimerInfo.getExpiryTimeInMs() >= (polled or 0):
                self.seen.clear()
            return
        if decided is None and polled is None:
            return
        winner = "decision" if decided is not None and (polled is None or decided <= polled + GRACE_MS) else "poll"
        forget = expiredTimerInfo.getExpiryTimeInMs() + REMEMBER_MS
        self.handle.registerTimer(forget)
        self.seen.update((None, forget, winner))
        yield Row(scenario_id=key[0], winner=winner)

    def close(self) -> None: ...


def grace(events: DataFrame, late: str = "1 second") -> DataFrame:
    """What counts in each race of a stream (scenario_id, time, event: decision or poll), once no earlier row can come."""
    use_state_store(events.sparkSession)
    rows = events.withWatermark("time", late).select("scenario_id", "time", "event", F.unix_millis("time").alias("ms"))
    return rows.groupBy("scenario_id").transformWithState(_Race(), "scenario_id long, winner string", "Append", "EventTime")
