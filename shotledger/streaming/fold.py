"""The fold of states as a stream: files of events in, the current state of each key out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.operators import states
from shotledger.sources.shared import new_folder, scratch


def event_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that appear in a folder under names of the pattern."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fold_stream(events: DataFrame, target: str, checkpoint: str, key: str = "job_id"):
    """Start the query: each batch writes the states of the keys it changed to a folder of its own number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    folded = states.fold(events, key)
    return folded.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def current(written: DataFrame, key: str = "job_id") -> DataFrame:
    """Of each key the state of the last batch that changed it."""
    names = [c for c in written.columns if c != "batch"]
    return written.groupBy(key).agg(F.max_by(F.struct(*names), F.col("batch")).alias("s")).select("s.*")


def fold_all(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Run the stream over all files there are, and return the current states."""
    spark = events.sparkSession
    with scratch(spark) as kept:
        target, checkpoint = new_folder(spark, "states"), new_folder(spark, "stream")
        fold_stream(events, target, checkpoint, key).awaitTermination()
        return kept(current(spark.read.parquet(target), key), "states")
