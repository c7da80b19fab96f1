"""Tables laid out once in buckets of the job, so that what joins and groups by job reads them without moving a row.

A layout is a set of tables in the session's catalog, in the warehouse folder. All have the same number of buckets by ``job_id`` and are sorted by it within; rows that belong to
a job by way of another table (a photo's details) get its id when they are written. Looking rows up by a few ids reads their buckets only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.operators.relations import active, latest_per_job
from shotledger.sources.shared import cleaned

#: So many ids at most are put into the filter that chooses buckets; more are joined.
FILTER_IDS = 1000
#: The fewest buckets, and so many rows of the largest table in each: a bucket is one task's, so their number grows with the rows and a task's memory doesn't.
BUCKETS, BUCKET_ROWS = 16, 500_000


def buckets_for(rows: DataFrame) -> int:
    """The number of buckets for tables of which ``rows`` is the largest; over a scan, counting reads no column."""
    return max(BUCKETS, -(-rows.count() // BUCKET_ROWS))


class Layout:
    def __init__(self, spark: SparkSession, key: str = "job_id", buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self._names: dict[str, str] = {}
        self._prefix = f"layout_{uuid.uuid4().hex}"

    def write(self, name: str, rows: DataFrame) -> None:
        """One file per bucket: rows are moved to their bucket's task before they are written."""
        full = f"{self._prefix}_{name}"
        self._names[name] = full
        with cleaned(self.spark):
            rows.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").saveAsTable(full)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._names[name])

    def lookup(self, name: str, ids: DataFrame) -> DataFrame:
        """The rows with one of the ids in the first column of ``ids``, null ids aside."""
        ids = ids.select(F.col(ids.columns[0]).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        some = [r[0] for r in ids.limit(FILTER_IDS + 1).collect()]
        if len(some) > FILTER_IDS:
            return self.table(name).join(ids, self.key, "left_semi").select(*self.table(name).columns)
        return self.table(name).where(F.col(self.key).isin(some))

    def drop(self) -> None:
        for full in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {full}")
        self._names = {}

    def __enter__(self) -> Layout:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()


def details_by_job(jobs: DataFrame, clusters: DataFrame, photos: DataFrame, runs: DataFrame) -> DataFrame:
    """What ``relations.job_details`` gives, by grouping and joining on the job alone: over a layout nothing is moved. Photos that aren't
    laid out are dealt out by job before (``repartition``), as they are grouped twice and would be moved each time.

    A cluster's photos are those of its own job that name it.
    """
    place = lambda key: [F.col("order_index").isNull().alias("_last"), F.col("order_index").alias("_index"), F.col(key).alias("_key")]
    shown = active(photos).withColumn("timestamp", F.when(F.col("cluster_id").isNotNull(), F.col("meta_timestamp")))
    inner = F.struct("photo_id", "order_index", "storage_path", "thumbnail_path", "meta_timestamp")
    outer = F.struct("photo_id", "cluster_id", "order_index", "timestamp")
    items = lambda c, field: F.transform(F.sort_array(F.collect_list(c)), lambda x: x[field])
    # Within a job's cluster first: the arrays of a job are put together from its clusters' arrays, which are sorted already.
    per_cluster = shown.groupBy("job_id", "cluster_id").agg(items(F.struct(*place("photo_id"), inner.alias("i")), "i").alias("inner"), F.collect_list(F.struct(*place("photo_id"), outer.alias("i"))).alias("all"))
    per_job = per_cluster.groupBy("job_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cluster_id").isNotNull(), F.struct("cluster_id", "inner")))).alias("_of"),
        F.transform(F.sort_array(F.flatten(F.collect_list("all"))), lambda x: x["i"]).alias("photos"),
    )
    in_jobs = clusters.groupBy("job_id").agg(items(F.struct(*place("cluster_id"), F.struct("cluster_id", "name", "order_index").alias("i")), "i").alias("_clusters"))
    newest = latest_per_job(runs).select("job_id", "export_id", F.col("status").alias("_status"))
    kinds = {c: per_job.schema[c].dataType for c in ("_of", "photos")}
    none = F.array().cast(kinds["_of"].valueType)
    photos_of = lambda c: F.coalesce(F.try_element_at("_of", c["cluster_id"]), none)
    nested = F.transform(F.coalesce("_clusters", F.array().cast(in_jobs.schema["_clusters"].dataType)), lambda c: F.struct(c["cluster_id"].alias("cluster_id"), c["name"].alias("name"), c["order_index"].alias("order_index"), photos_of(c).alias("photos")))
    out = jobs.join(newest, "job_id", "left").join(in_jobs, "job_id", "left").join(per_job, "job_id", "left")
    out = out.withColumns({"export_status": F.coalesce("_status", F.lit("PENDING")), "clusters": nested, "photos": F.coalesce("photos", F.array().cast(kinds["photos"]))})
    return out.drop("_status", "_clusters", "_of")
