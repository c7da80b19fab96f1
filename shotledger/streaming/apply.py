"""The clustering worker's replies applied as they come: each batch changes all tables of the store in one commit, and never twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.operators import clustering
from shotledger.sources.shared import materialise, scratch, sized_broadcasts
from shotledger.sources.versions import Store

#: The tables that a reply changes, and what each is laid out by. Details carry their photo's job.
KEYS = {"runs": "cluster_job_id", "jobs": "job_id", "clusters": "job_id", "photos": "job_id", "details": "job_id"}


def lay_out(store: Store, tables: dict[str, DataFrame], buckets: int) -> None:
    """The first version: each table in so many buckets, so that a batch rewrites those of its jobs only."""
    details = tables["details"].join(tables["photos"].select("photo_id", "job_id"), "photo_id")
    with sized_broadcasts(store.spark), store.transaction("lay out") as t:
        for name, key in KEYS.items():
            rows = details if name == "details" else tables[name]
            if name == "clusters":
                rows = rows.select("cluster_id", "job_id", "name", "order_index")
            t.replace(name, rows, by=(key, buckets))


def apply_batch(store: Store, stream: str, number: int, batch: DataFrame, now: Column) -> bool:
    """Apply a batch of replies (``request_id, status, error, result``) as ``clustering.apply_replies`` does; False if this batch is in the store already."""
    # The store's tables are read in its own session, a stream's batch in another.
    with sized_broadcasts(store.spark), sized_broadcasts(batch.sparkSession), scratch(batch.sparkSession), store.transaction(f"{stream} {number}", token=(stream, number)) as t:
        if t.done_before():
            return False
        known = batch.where(F.col("status").isin("completed", "failed")).select("request_id", "status", "error", "result")
        replies = materialise(known, "replies")
        asked = store.buckets_of("runs", replies.select("request_id"), t.base)
        runs = t.read("runs", asked)
        jobs = materialise(runs.join(replies.select(F.col("request_id").alias("cluster_job_id")), "cluster_job_id", "left_semi").select("job_id"), "jobs")
        some = store.buckets_of("jobs", jobs, t.base)
        before = {name: t.read(name, some) for name in KEYS if name != "runs"}
        after = clustering.apply_replies(replies, runs, before["jobs"], before["clusters"], before["photos"], before["details"].drop("job_id"), now)
        # No photo changes its job, so it is read from what was, and photos aren't made twice.
        after["details"] = after["details"].join(before["photos"].select("photo_id", "job_id"), "photo_id")
        for name in KEYS:
            where = asked if name == "runs" else some
            if where:
                t.replace_buckets(name, after[name], where)
    return True


def apply_stream(replies: DataFrame, store: Store, stream: str, checkpoint: str, now: Column) -> None:
    """Run over all replies there are. A batch that is run again after a failure finds itself in the store and changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        apply_batch(store, stream, number, batch, now)

    replies.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
