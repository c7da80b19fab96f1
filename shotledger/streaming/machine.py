"""State machines of jobs and exports as a stream: every event is taken or refused by the state that the events before it left.

Events may come out of order. Each waits in the state of its key until the watermark has passed its time, when nothing earlier can come any more; then all that is ripe is applied in the order of time then
id, so that the stream says of each event what ``states.run_machine`` says over the whole table. Events that come later than ``delay`` behind the newest are dropped by Spark; ``unheard`` tells
which those are. A query that is started again goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Machine(StatefulProcessor):
    """Per key the state, and the events that wait for the watermark."""

    def __init__(self, steps: dict[str | None, tuple[str, ...]]):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, due_ms long")
        self.waiting = handle.getListState("waiting", "us long, event_id long, status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(us), int(i), s) for part in rows for us, i, s in zip(part["us"], part["event_id"], part["status"]) if not pd.isna(i)]
        if new:
            self.waiting.appendList(new)
            status, due = self.state.get() if self.state.exists() else (None, None)
            first = self._due(new)
            if due is None or first < due:
                self._wake(status, first, due)
        return iter(())

    @staticmethod
    def _due(events: list[tuple]) -> int:
        """When the first of the events is ripe: in whole milliseconds, not before it."""
        return -(-min(e[0] for e in events) // 1000)

    def _wake(self, status: str | None, due: int | None, before: int | None = None) -> None:
        """One timer per key, for the first event that waits."""
        if before is not None:
            self.handle.deleteTimer(before)
        if due is not None:
            self.handle.registerTimer(due)
        self.state.update((status, due))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = list(self.waiting.get())
        ripe = sorted(e for e in waiting if e[0] <= upto)
        rest = [e for e in waiting if e[0] > upto]
        self.waiting.put(rest) if rest else self.waiting.clear()
        state = self.state.get()[0]
        out = []
        for us, event_id, wanted in ripe:
            taken = wanted in self.steps.get(state, ())
            state = wanted if taken else state
            out.append((*key, event_id, us, wanted, state, taken))
        self._wake(state, self._due(rest) if rest else None)
        yield pd.DataFrame(out, columns=["key", "event_id", "us", "wanted", "status", "taken"])


def outcomes(events: DataFrame, steps: dict[str | None, tuple[str, ...]], key: str = "job_id", delay: str = "1 hour") -> DataFrame:
    """A stream of ``key, event_id, ts, wanted, status, taken`` for a stream of ``key, event_id, ts, status``: the state after each event, and whether the event changed it.

    Rows with a null ``event_id`` only move time on. The session needs the state store ``ROCKS_DB``.
    """
    kind = dict(events.dtypes)[key]
    timed = events.select(F.col(key).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", delay)
    timed = timed.withColumn("us", F.unix_micros("ts"))
    told = timed.groupBy("key").transformWithStateInPandas(_Machine(steps), f"key {kind}, event_id long, us long, wanted string, status string, taken boolean", "Append", "EventTime")
    return told.select(F.col("key").alias(key), "event_id", F.timestamp_micros("us").alias("ts"), "wanted", "status", "taken")


def write_log(told: DataFrame, target: str, checkpoint: str) -> None:
    """Run the stream over all that there is, each batch to a folder of its own number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    conf = told.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS_DB)
    try:
        told.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        conf.set(STORE, before)


def states_of(log: DataFrame, key: str = "job_id") -> DataFrame:
    """From the log of outcomes what ``states.run_machine`` gives: ``key, status, at, n_events, n_refused``."""
    last = F.max_by("status", F.struct("ts", "event_id"))
    return log.groupBy(key).agg(last.alias("status"), F.max(F.when(F.col("taken"), F.col("ts"))).alias("at"), F.count("*").alias("n_events"), F.count_if(~F.col("taken")).alias("n_refused"))


def unheard(events: DataFrame, log: DataFrame) -> DataFrame:
    """Events, as a table, that the log doesn't have: they came too late, or the watermark hasn't passed them yet."""
    return events.join(log.select("event_id"), "event_id", "left_anti")
