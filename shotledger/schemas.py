"""Fixed schemas of the tables and of the JSON payloads. Nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)  # noqa: SLF001


#: States of jobs and of exports.
JOB_STATES = ("CREATED", "UPLOADING", "PENDING", "PROCESSING", "DELETED", "FAILED", "COMPLETED")
EXPORT_STATES = ("PENDING", "PROCESSING", "FAILED", "EXPORTED")
#: Name and place of the cluster that holds what belongs to no other.
RESERVE, RESERVE_INDEX = "reserve", -1

TABLES = {
    "users": "user_id string, username string, company_name string, created_at timestamp, updated_at timestamp",
    "jobs": "job_id string, user_id string, title string, status string, construction_type string, company_name string, created_at timestamp, updated_at timestamp",
    "clusters": "cluster_id string, job_id string, name string, order_index int, created_at timestamp",
    "photos": (
        "photo_id string, job_id string, cluster_id string, original_filename string, storage_path string, thumbnail_path string, url string, thumbnail_url string, "
        "order_index int, labels map<string,string>, meta_lat double, meta_lon double, meta_timestamp timestamp_ntz, created_at timestamp, deleted_at timestamp"
    ),
    "photo_details": "detail_id string, photo_id string, device string, focal_length double, exposure_time double, iso int, flash int, orientation int, gps_img_direction double",
    "cluster_jobs": "cluster_job_id string, job_id string, error_message string, result string, created_at timestamp_ntz, finished_at timestamp_ntz",
    "export_jobs": (
        "export_id string, job_id string, status string, cover_title string, cover_company_name string, pdf_path string, error_message string, "
        "labels map<string,string>, created_at timestamp_ntz, finished_at timestamp_ntz"
    ),
}

PAYLOADS = {
    "cluster_result": (
        "struct<task_id: string, status: string, request_id: string, error: string, result: struct<clusters: array<struct<id: int, photos: array<struct<path: string, timestamp: double, "
        "lat: double, lon: double, device: string, focal_length: double, exposure_time: double, iso_speed_rating: int, flash: int, orientation: int, gps_img_direction: double>>>>>>"
    ),
    "export_result": "struct<task_id: string, request_id: string, status: string, error: string, result: struct<pdf_url: string>>",
    "cluster_sync": "struct<clusters: array<struct<id: string, name: string, order_index: int, photo_ids: array<string>>>>",
    "upload_complete": "array<struct<filename: string, storage_path: string, thumbnail_path: string>>",
}


def table_schema(name: str) -> T.StructType:
    return _struct(TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a table in their order: missing ones are null, others are dropped, types are cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(name)])


def key(prefix: str, *parts: Column) -> Column:
    """A stable id: the prefix and ten hex digits of a hash of the natural key."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 10))


def evolve(df: DataFrame, add: dict[str, str] | None = None, drop: tuple[str, ...] = (), narrow: dict[str, int] | None = None) -> DataFrame:
    """A schema change: new columns start null, dropped ones go, narrowed texts must fit or the query stops."""
    out = df.drop(*drop)
    for name, kind in (add or {}).items():
        out = out.withColumn(name, F.lit(None).cast(kind))
    for name, size in (narrow or {}).items():
        fits = F.col(name).isNull() | (F.char_length(name) <= size)
        out = out.withColumn(name, F.when(fits, F.col(name)).otherwise(F.raise_error(F.lit(f"{name} is longer than {size}")).cast("string")))
    return out
