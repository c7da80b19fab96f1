"""What callers see: fixed projections of jobs, photos, clusters, users and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.operators.relations import clusters_with_photos, jobs_with_latest_run, nested


def job_list(jobs: DataFrame, runs: DataFrame, user_id: int | str | None = None, unfinished_only: bool = False) -> DataFrame:
    """A user's jobs (or all) with five fields; the export state is PENDING where there is no run."""
    own = jobs if user_id is None else jobs.where(F.col("user_id") == user_id)
    return jobs_with_latest_run(own, runs, unfinished_only).select("job_id", "title", "status", "created_at", "export_status")


def created_job(jobs: DataFrame) -> DataFrame:
    """A job as it is shown right after it is made."""
    return jobs.select("job_id", "title", "status", "construction_type", "company_name", "created_at", F.lit("PENDING").alias("export_status"))


def photo_view(photos: DataFrame) -> DataFrame:
    """Photos with the time they were taken named ``timestamp``."""
    return photos.select("photo_id", "job_id", "cluster_id", "storage_path", "thumbnail_path", "order_index", F.col("meta_timestamp").alias("timestamp"))


def cluster_view(clusters: DataFrame, photos: DataFrame) -> DataFrame:
    """Clusters by place with their active photos as they are shown."""
    shown = F.transform("photos", lambda p: F.struct(p["photo_id"].alias("id"), p["order_index"].alias("order_index"), p["storage_path"].alias("url"), F.nullif(p["thumbnail_path"], F.lit("")).alias("thumbnail_path"), p["meta_timestamp"].alias("timestamp")))
    return clusters_with_photos(clusters, photos).select("cluster_id", "job_id", "name", "order_index", shown.alias("photos"))


def edited_cluster_view(clusters: DataFrame, photos: DataFrame) -> DataFrame:
    """Clusters as they are answered after they are made or changed: all their photos, deleted ones too, with every field of a photo, and the thumbnail's URL as its path."""
    fields = ("job_id", "order_index", F.col("meta_timestamp").alias("timestamp"), F.map_entries("labels").alias("labels"), "cluster_id", "storage_path", "original_filename", "url", F.col("thumbnail_url").alias("thumbnail_path"))
    lists = nested(photos.withColumn("item", F.struct(F.col("photo_id").alias("id"), *fields)), "cluster_id", "photos", "item", key="photo_id")
    # Maps can't be sorted on the way, their entries can.
    shown = F.transform("photos", lambda p: p["item"].withField("labels", F.map_from_entries(p["item"]["labels"])))
    return clusters.join(lists, "cluster_id", "left").select("cluster_id", "job_id", "name", "order_index", F.coalesce(shown, F.array().cast(lists.select(shown.alias("p")).schema["p"].dataType)).alias("photos"))


def photos_with_details(photos: DataFrame, details: DataFrame) -> DataFrame:
    """Photos, each with what its camera said as a struct ``detail``, null where there is nothing. A photo has one row of details at most."""
    names = [c for c in details.columns if c != "photo_id"]
    own = details.select("photo_id", F.struct(*names).alias("detail"))
    return photos.join(own, "photo_id", "left").select(*photos.columns, "detail")


def profile(users: DataFrame) -> DataFrame:
    """Users without anything secret."""
    return users.drop("password_hash", "password")


def export_status(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """State, file and error of each job's newest export; PENDING and nulls where there is none."""
    latest = jobs_with_latest_run(jobs, runs).select("job_id", "export_id", "export_status")
    files = runs.select("export_id", F.nullif("pdf_path", F.lit("")).alias("pdf_path"), "error_message")
    return latest.join(files, "export_id", "left").select("job_id", "export_status", "pdf_path", "error_message")
