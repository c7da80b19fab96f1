"""Reads across tables: latest run per job, nested views, payloads, and matching by path suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotledger.functions import scalars as X


def active(rows: DataFrame) -> DataFrame:
    """Rows that aren't softly deleted."""
    return rows.where(F.col("deleted_at").isNull())


def matching(rows: DataFrame, *predicates: Column | None) -> DataFrame:
    """Rows for which all predicates hold; those given as None are left out."""
    for p in predicates:
        if p is not None:
            rows = rows.where(p)
    return rows


def ordered_position(rows: DataFrame, parent: str, key: str) -> DataFrame:
    """``position`` from 0 in each parent, by order_index with null last, then by key."""
    order = Window.partitionBy(parent).orderBy(F.col("order_index").asc_nulls_last(), key)
    return rows.withColumn("position", F.row_number().over(order) - 1)


def latest_per_job(runs: DataFrame, key: str = "export_id") -> DataFrame:
    """The newest run of each job; one without a creation time counts as newest."""
    newest = F.min_by(F.struct(*runs.columns), F.struct(F.col("created_at").isNotNull(), -F.unix_micros(F.col("created_at").cast("timestamp")), F.col(key)))
    return runs.groupBy("job_id").agg(newest.alias("_r")).select(*[F.col("job_id" if c == "job_id" else f"_r.{c}").alias(c) for c in runs.columns])


def jobs_with_latest_run(jobs: DataFrame, runs: DataFrame, unfinished_only: bool = False) -> DataFrame:
    """All jobs with the state of their newest run, PENDING where there is none.

    With ``unfinished_only`` finished runs are left out before the join, so a job with finished runs only reads PENDING.
    """
    some = runs.where(F.col("finished_at").isNull()) if unfinished_only else runs
    latest = latest_per_job(some).select("job_id", "export_id", F.col("status").alias("run_status"))
    return jobs.join(latest, "job_id", "left").withColumn("export_status", F.coalesce("run_status", F.lit("PENDING"))).drop("run_status")


def nested(rows: DataFrame, parent: str, name: str, *fields: str, key: str) -> DataFrame:
    """One row per parent with an array of structs, by order_index with null last, then by key.

    The rows themselves are moved to their parent's task: lists made before, of a row or two each, hold key and place twice and are larger than the rows.
    """
    item = F.struct(F.col("order_index").isNull().alias("_last"), F.col("order_index").alias("_index"), F.col(key).alias("_key"), F.struct(*fields).alias("item"))
    needed = rows.select(*dict.fromkeys((parent, "order_index", key, *fields)))
    return needed.repartition(parent).groupBy(parent).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias(name))


def clusters_with_photos(clusters: DataFrame, photos: DataFrame, active_only: bool = True) -> DataFrame:
    """Clusters, each with its photos nested in order; clusters without photos have an empty array."""
    rows = active(photos) if active_only else photos
    lists = nested(rows, "cluster_id", "photos", "photo_id", "order_index", "storage_path", "thumbnail_path", "meta_timestamp", key="photo_id")
    return clusters.join(lists, "cluster_id", "left").withColumn("photos", F.coalesce("photos", F.array().cast(lists.schema["photos"].dataType)))


def job_details(jobs: DataFrame, clusters: DataFrame, photos: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs with their clusters (each with its photos), all their photos, and the state of their newest run.

    Softly deleted photos are left out everywhere. ``timestamp`` is set on photos that lie in a cluster only.
    """
    whole = clusters_with_photos(clusters, photos)
    in_jobs = nested(whole, "job_id", "clusters", "cluster_id", "name", "order_index", "photos", key="cluster_id")
    shown = active(photos).withColumn("timestamp", F.when(F.col("cluster_id").isNotNull(), F.col("meta_timestamp")))
    all_photos = nested(shown, "job_id", "photos", "photo_id", "cluster_id", "order_index", "timestamp", key="photo_id")
    out = jobs_with_latest_run(jobs, runs).join(in_jobs, "job_id", "left").join(all_photos, "job_id", "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in (("clusters", in_jobs.schema["clusters"].dataType), ("photos", all_photos.schema["photos"].dataType))})


def export_payload(clusters: DataFrame, photos: DataFrame) -> DataFrame:
    """What a report is made of: clusters with photos, the reserve cluster left out; each photo with its path and time as text."""
    shown = active(photos).select("cluster_id", "photo_id", "order_index", X.first_filled(F.col("thumbnail_path"), F.col("storage_path")).alias("path"), X.iso_text(F.col("meta_timestamp")).alias("timestamp"))
    lists = nested(shown, "cluster_id", "photos", "photo_id", "path", "timestamp", key="photo_id")
    return clusters.where(F.col("name") != "reserve").join(lists, "cluster_id").select("job_id", "cluster_id", F.col("name").alias("title"), "order_index", "photos")


def suffix_match(items: DataFrame, photos: DataFrame) -> DataFrame:
    """Each payload item with the first photo of its job whose stored path ends the item's path; items without one go.

    ``items`` has ``job_id, item, path``. The stored path is the thumbnail's, or the photo's own where that is missing. The lengths that
    stored paths have in a job are few, so an item is joined by equality on its endings of these lengths, not by trying all photos.
    """
    keyed = photos.select("job_id", "photo_id", X.first_filled(F.col("thumbnail_path"), F.col("storage_path")).alias("ending")).where("ending is not null")
    first = keyed.groupBy("job_id", "ending").agg(F.min("photo_id").alias("photo_id"))
    lengths = first.select("job_id", F.char_length("ending").alias("n")).distinct()
    tried = items.join(lengths, "job_id").where(F.col("n") <= F.char_length("path")).withColumn("ending", F.expr("right(path, n)"))
    hits = tried.join(first, ["job_id", "ending"])
    return hits.groupBy("job_id", "item", "path").agg(F.min("photo_id").alias("photo_id"))


def last_written(hits: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with one key, that with the greatest order."""
    cols = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, "r.*")


def in_list_order(lists: DataFrame, photos: DataFrame, by_index: bool = False) -> DataFrame:
    """Photos named in ``photo_ids`` of each list row, numbered from 0 in the list's order, or in the photos' own."""
    named = lists.select(*[c for c in lists.columns if c != "photo_ids"], F.posexplode("photo_ids").alias("place", "photo_id")).join(photos.select("photo_id", F.col("order_index").alias("old_index")), "photo_id")
    by = [F.col("old_index").asc_nulls_last(), F.col("photo_id")] if by_index else [F.col("place")]
    return named.withColumn("order_index", F.row_number().over(Window.partitionBy("list_id").orderBy(*by)) - 1)


def bucket_folder(photos: DataFrame) -> DataFrame:
    """Per job the folder its photos lie in: that of the first thumbnail there is, else of the first photo with a path of its own."""
    first = lambda c: F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.struct(F.col("order_index").isNull(), "order_index", "photo_id")))
    per_job = photos.groupBy("job_id").agg(first("thumbnail_path").alias("thumb"), first("storage_path").alias("own"), F.count("*").alias("photo_cnt"))
    return per_job.select("job_id", F.coalesce(X.parent(F.col("thumb")), X.parent(F.col("own"))).alias("bucket_path"), "photo_cnt")


def status_gates(jobs: DataFrame) -> DataFrame:
    """What may be done with a job in its state."""
    return jobs.select(
        "*",
        F.col("status").isin("CREATED", "FAILED", "COMPLETED").alias("may_cluster"),
        F.when(F.col("export_status").isin("PENDING", "PROCESSING") & F.col("export_id").isNotNull(), "existing").otherwise("new").alias("export_is"),
        ((F.col("export_status") == "EXPORTED") & (F.coalesce("pdf_path", F.lit("")) != "")).alias("may_download"),
    )


def histogram(rows: DataFrame, group: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Count, sum and cumulative counts up to each bound, per group."""
    upto = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *upto)


def deltas(rows: DataFrame) -> DataFrame:
    """``task, seconds, mib``: run time and growth of memory of each run, from ``began, ended`` and the bytes ``before, after``."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("began"), F.col("ended")) / 1e6
    return rows.select("task", seconds.alias("seconds"), X.mebibytes(F.col("after") - F.col("before")).alias("mib"))
