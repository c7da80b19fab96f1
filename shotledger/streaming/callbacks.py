"""Replies of the workers as a stream of JSON files, joined with the requests they answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.schemas import PAYLOADS
from shotledger.sources.shared import new_folder, settings

#: What opening a file counts as, when files are dealt out to tasks. By Spark's own 4 MB a task gets 32 files, and replies are far smaller.
OPEN_BYTES = 64 << 10
#: A batch of a stream looks its files up one by one, by Spark's own setting in up to 10,000 tasks; so many for each core are enough.
LISTING_TASKS = 4


def reply_stream(spark: SparkSession, folder: str, payload: str = "export_result") -> DataFrame:
    """One row per file: its text, what it parses to, and whether it is JSON at all."""
    # Whole files as binaries: the reader of texts makes a copy of Hadoop's whole configuration for each file, which takes far longer than a reply's few bytes.
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    text = files.select(F.col("content").cast("string").alias("value"))
    parsed = F.from_json("value", PAYLOADS[payload])
    return text.select(parsed.alias("p"), F.col("value").alias("body")).select("body", "p.*", F.col("p.request_id").isNotNull().alias("readable"))


def as_events(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """State events of known requests: ``completed`` is EXPORTED with its file, ``failed`` is FAILED with its message; other states and unknown ids change nothing."""
    done = F.col("status") == "completed"
    known = replies.where("readable").where(F.col("status").isin("completed", "failed")).withColumnRenamed("request_id", "export_id").join(requests, "export_id")
    return known.select("job_id", "export_id", F.when(done, "EXPORTED").otherwise("FAILED").alias("status"), F.when(~done, F.col("error")).alias("error"), F.when(done, F.col("result.pdf_url")).alias("pdf_path"))


def collected(replies: DataFrame, each: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Run the stream over all files there are, and return the replies as a table; a batch that is run again replaces itself. ``each`` is done to each batch: joins belong there, as within the
    stream's own plan each look at a join's sizes walks over all files of the batch in the driver."""
    spark = replies.sparkSession
    target, checkpoint = new_folder(spark, "replies"), new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    with settings(spark, {"spark.sql.files.openCostInBytes": str(OPEN_BYTES), "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTING_TASKS * spark.sparkContext.defaultParallelism)}):
        replies.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = each(replies)
    return spark.read.schema(out.schema).parquet(target).select(*out.columns)
