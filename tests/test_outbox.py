"""Requests written once whatever tasks do, and replies read from where the reader stopped."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shotledger.sources import outbox
from tests.test_operators import rows

UNTIL = dt.datetime(2024, 1, 1, 12)


@pytest.fixture
def box(spark, tmp_path):
    outbox.register(spark)
    return str(tmp_path / "box")


def requests(spark, a, b, parts=4):
    return spark.range(a, b, 1, parts).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("export").alias("kind"), F.concat(F.lit('{"n": "é'), "id", F.lit('"}')).alias("body"), F.lit(1).alias("tries"), F.lit(UNTIL).alias("send_until"))


def read(spark, box):
    return spark.read.format("shotledger_outbox").load(box)


def test_batches(spark, box):
    for a, b in ((0, 10), (10, 12), (12, 12)):
        requests(spark, a, b).write.format("shotledger_outbox").mode("append").save(box)
    assert rows(read(spark, box).select("request_id", "body", "tries", "send_until")) == rows(requests(spark, 0, 12).select("request_id", "body", "tries", "send_until"))
    assert [c["n"] for c in outbox.commits(box)] == [10, 2, 0]
    with pytest.raises(Exception, match="only added to"):
        requests(spark, 0, 1).write.format("shotledger_outbox").mode("overwrite").save(box)


def test_a_failing_job_leaves_nothing(spark, box):
    bad = requests(spark, 0, 100).withColumn("body", F.when(F.col("request_id") == "r99", F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("shotledger_outbox").mode("append").save(box)
    assert outbox.commits(box) == [] and read(spark, box).count() == 0
    requests(spark, 0, 3).write.format("shotledger_outbox").mode("append").save(box)
    assert read(spark, box).count() == 3


def test_a_lost_task_that_is_run_again(spark, box):
    """Files of tasks whose result was lost are in the folder and in no commit."""
    writer = outbox._BatchWriter({"path": f"file://{box}"})
    batch = requests(spark, 0, 5).toArrow().to_batches()
    writer.write(iter(batch))  # written, and its executor lost before it could say so
    second = writer.write(iter(batch))
    writer.commit([second])
    assert len(os.listdir(f"{box}/files")) == 2 and read(spark, box).count() == 5
    stream = outbox._StreamWriter({"path": box})
    for _ in range(2):  # a batch that is run again after its commit
        stream.commit([stream.write(iter(batch))], 7)
    assert read(spark, box).count() == 10


def test_streams(spark, box, tmp_path):
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(requests(spark, 0, 1).schema).parquet(source)

    def send():
        stream().writeStream.format("shotledger_outbox").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(box).awaitTermination()

    for k in range(3):
        requests(spark, 10 * k, 10 * k + 10, 1).write.mode("append").parquet(source)
        send()
    send()
    assert rows(read(spark, box).select("request_id")) == rows(requests(spark, 0, 30).select("request_id"))

    replies = str(tmp_path / "replies")
    answer = lambda a, b: spark.range(a, b).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("completed").alias("status"), F.lit("{}").alias("body"))
    target = str(tmp_path / "out")

    def take():
        found = spark.readStream.format("shotledger_replies").option("perBatch", 2).load(replies)
        query = found.writeStream.option("checkpointLocation", str(tmp_path / "c2")).format("parquet").start(target)
        query.processAllAvailable()
        query.stop()

    for k in range(5):
        answer(5 * k, 5 * k + 5).write.format("shotledger_outbox").mode("append").save(replies)
        if k != 1:
            take()
    got = spark.read.parquet(target)
    assert got.count() == 25 and got.select("request_id").distinct().count() == 25 and rows(got.select("commit").distinct()) == [(k,) for k in range(5)]


def test_due(spark):
    at = lambda m: UNTIL + dt.timedelta(minutes=m)
    sent = spark.createDataFrame([("a", "k", "b", 1, at(0)), ("b", "k", "b", 1, at(0)), ("b", "k", "b", 2, at(5)), ("c", "k", "b", 3, at(1)), ("d", "k", "b", 1, at(60)), ("e", "k", "b", 1, at(0))], outbox.REQUEST)
    replies = spark.createDataFrame([("e",), ("z",)], "request_id string")
    again, given_up = outbox.due(sent, replies, F.lit(at(10)))
    assert rows(again.select("request_id", "tries", "send_until")) == [("a", 2, at(11)), ("b", 3, at(11))] and rows(given_up) == [("c", 3)]
