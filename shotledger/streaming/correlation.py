"""Requests and the replies to them as two streams: which are answered, which never were, and which replies nobody asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlated(requests: DataFrame, replies: DataFrame, limit: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """A stream of ``request_id, asked_at, answered_at, status, outcome``; each request and each reply comes out once.

    ``requests`` has ``request_id, asked_at``, one row per request, and ``replies`` has ``request_id, answered_at, status``. A reply no later than ``limit`` after its request makes it ``answered``, as soon as both are there, in either order.
    When the watermark (``delay`` behind the newest of the slower stream) says that no reply in time can come any more, a request is ``unanswered``; a reply that no request
    in time can match is ``unknown``. Replies that repeat one no more than ``delay`` old are dropped. Rows with a null ``request_id`` only move time on.
    """
    asked = requests.select("request_id", "asked_at").withWatermark("asked_at", delay)
    said = replies.select(F.col("request_id").alias("reply_to"), "answered_at", "status").withWatermark("answered_at", delay).dropDuplicatesWithinWatermark(["reply_to"])
    in_time = (F.col("request_id") == F.col("reply_to")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"INTERVAL {limit}"))
    both = asked.join(said, in_time, "full_outer")
    outcome = F.when(F.col("reply_to").isNull(), "unanswered").when(F.col("request_id").isNull(), "unknown").otherwise("answered")
    return both.select(F.coalesce("request_id", "reply_to").alias("request_id"), "asked_at", "answered_at", "status", outcome.alias("outcome")).where("request_id is not null")
