"""States of jobs and exports as folds of their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may follow each state of a job and of an export; None is the start.
JOB_STEPS = {
    None: ("CREATED",), "CREATED": ("UPLOADING", "PENDING", "DELETED"), "UPLOADING": ("CREATED", "DELETED"), "PENDING": ("UPLOADING", "PROCESSING", "COMPLETED", "FAILED", "DELETED"),
    "PROCESSING": ("UPLOADING", "COMPLETED", "FAILED", "DELETED"), "COMPLETED": ("PENDING", "UPLOADING", "DELETED"), "FAILED": ("PENDING", "UPLOADING", "DELETED"), "DELETED": (),
}
EXPORT_STEPS = {None: ("PENDING",), "PENDING": ("PROCESSING", "EXPORTED", "FAILED"), "PROCESSING": ("EXPORTED", "FAILED"), "EXPORTED": (), "FAILED": ()}


def fold(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The state after all events of a key, in the order of time then id: ``status``, the last error, and the number of events.

    ``events`` has ``key, event_id, ts, status, error``. FAILED keeps its message; a later state that isn't FAILED clears it.
    """
    order = F.struct("ts", "event_id")
    last = F.max_by(F.struct("status", F.when(F.col("status") == "FAILED", F.col("error")).alias("error"), "ts"), order)
    return events.groupBy(key).agg(last.alias("s"), F.count("*").alias("n_events")).select(key, "s.status", "s.error", F.col("s.ts").alias("at"), "n_events")


def correlate(replies: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies with the request they answer, and replies to requests that nobody made."""
    known = replies.join(requests, "request_id")
    return known, replies.join(requests.select("request_id").distinct(), "request_id", "left_anti")


def next_state(steps: dict[str | None, tuple[str, ...]], state: Column, wanted: Column) -> Column:
    """``wanted`` if it may follow ``state``, else ``state``."""
    allowed = F.lit(False)
    for before, after in steps.items():
        if after:
            allowed = allowed | ((state.isNull() if before is None else state == before) & wanted.isin(*after))
    return F.when(F.coalesce(allowed, F.lit(False)), wanted).otherwise(state)


def run_machine(events: DataFrame, steps: dict[str | None, tuple[str, ...]], key: str = "job_id") -> DataFrame:
    """The state of each key after its events in the order of time then id, when events that may not follow the state change nothing.

    ``events`` has ``key, event_id, ts, status``. Gives ``key, status, at, n_events, n_refused``; ``at`` is the time of the last step. The events of one key are one array,
    as each depends on the state before it: a job or export has a handful.
    """
    line = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "status"))).alias("line"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast(dict(events.dtypes)["ts"]).alias("at"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        after = next_state(steps, s["status"], e["status"])
        taken = ~after.eqNullSafe(s["status"])
        return F.struct(after.alias("status"), F.when(taken, e["ts"]).otherwise(s["at"]).alias("at"), (s["refused"] + F.when(taken, 0).otherwise(1)).alias("refused"))

    folded = line.select(key, F.aggregate("line", start, step).alias("s"), F.size("line").alias("n_events"))
    return folded.select(key, "s.status", "s.at", F.col("n_events").cast("long"), F.col("s.refused").cast("long").alias("n_refused"))
