"""Registered queries over files: given tables are written as objects to the shared folder, and read back by the sources."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.functions import scalars as X
from shotledger.plans.catalog import query
from shotledger.sources import files, photos, tables
from shotledger.sources.shared import new_folder, scratch
from shotledger.streaming import callbacks


def _name(path: str) -> F.Column:
    return X.basename(F.col(path))


@query(
    """SELECT page_id || CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' ELSE '.JPEG' END AS name, octet_length(encode(html))::BIGINT AS length, 'local' AS kind FROM pages WHERE page_id % 4 <> 3"""
)
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Pages written under names of photos and others; the photos are listed."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".JPEG", ".txt")]), (F.col("page_id") % 4 + 1).cast("int"))
    with scratch(spark) as kept:
        folder = new_folder(spark, "listing")
        files.put_objects(tables.scan(spark, d, "pages").select(F.concat("page_id", suffix).alias("name"), F.encode("html", "UTF-8").alias("content")), folder)
        found = files.list_photos(spark, folder)
        return kept(found.select(_name("path").alias("name"), "length", files.scheme_of(F.col("path")).alias("kind")), "listing")


@query(
    """SELECT page_id || '.html' AS name, upper(substr(hex(encode(html)), 1, 202)) AS head, sha256(html) AS whole, page_id % 2 = 0 AS in_even FROM pages"""
)
def file_contents(spark: SparkSession, d: str) -> DataFrame:
    """The first 101 bytes and the whole of each file, and which of them lie below a folder."""
    folder_of = F.when(F.col("page_id") % 2 == 0, "even/").otherwise("even-not/")
    with scratch(spark) as kept:
        folder = new_folder(spark, "contents")
        files.put_objects(tables.scan(spark, d, "pages").select(F.concat(folder_of, "page_id", F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content")), folder)
        found = []
        for part in ("even", "even-not"):
            heads = files.contents(spark, f"{folder}/{part}", 100).select("path", F.hex("content").alias("head"))
            wholes = files.contents(spark, f"{folder}/{part}").select("path", F.sha2("content", 256).alias("whole"))
            found.append(heads.join(wholes, "path"))
        rows = found[0].union(found[1])
        # The folder as listings write it, from a listing that opens no file.
        even = re.match("(.*)/even/", files.contents(spark, f"{folder}/even").select("path").first()[0])[0]
        inside = files.below(rows, even).withColumn("in_even", F.lit(True))
        other = files.outside(rows, even).withColumn("in_even", F.lit(False))
        return kept(inside.union(other).select(_name("path").alias("name"), "head", "whole", "in_even"), "contents")


@query(
    """SELECT page_id || CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '.txt' END AS name, CASE WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 2 = 0 THEN '{}' ELSE '' END ELSE '{"url": "' || url || '"}' END AS value FROM pages"""
)
def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole files as texts; empty ones are ``{}`` if they should be JSON."""
    name = F.concat("page_id", F.when(F.col("page_id") % 2 == 0, ".json").otherwise(".txt"))
    body = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit('{"url": "'), "url", F.lit('"}')))
    with scratch(spark) as kept:
        folder = new_folder(spark, "texts")
        rows = tables.scan(spark, d, "pages").select(name.alias("name"), F.encode(body, "UTF-8").alias("content"))
        files.put_objects(rows, folder)
        return kept(files.read_paths(rows.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))).select(_name("path").alias("name"), "value"), "texts")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'gcs' WHEN 1 THEN 'gcs' ELSE 'local' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'http' ELSE 'local' END AS origin FROM events")
def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    at = F.element_at(F.array(*[F.lit(x) for x in ("gs://b/", "gcs://b/", "file:///b/", "b/")]), (n % 4 + 1).cast("int"))
    rows = tables.scan(spark, d, "events").select("event_id", files.scheme_of(F.concat(at, n.cast("string"))).alias("kind"), F.concat(F.when(n % 3 == 0, "https://h/").otherwise("h/"), n.cast("string")).alias("path"))
    return photos.by_origin(rows).select("event_id", "kind", "origin")


def exif_photo(number: int) -> bytes:
    """A photo file with camera metadata made from a number: every seventh isn't a photo, every fifth has no thumbnail, every third no place."""
    if number % 7 == 0:
        return b"not a photo"
    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    long = lambda n: (4, 1, struct.pack("<I", n))
    ratio = lambda *xs: (5, len(xs) // 2, struct.pack(f"<{len(xs)}I", *xs))

    def block(start: int, tags: list[tuple], following: int = 0) -> bytes:
        head, data, at = struct.pack("<H", len(tags)), b"", start + 6 + 12 * len(tags)
        for tag, kind, count, raw in tags:
            head += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(data)))
            data += raw if len(raw) > 4 else b""
        return head + struct.pack("<I", following) + data

    main = [(0x010F, *text("Maker")), (0x0110, *text(f"Cam {number % 10}")), (0x0112, 3, 1, struct.pack("<H", number % 8 + 1)), (0x0132, *text("2000:01:01 00:00:00")), (0x8769, *long(300)), (0x8825, *long(500))]
    taken = [(0x9003, *text(f"2024:01:{number % 28 + 1:02d} 10:{number % 60:02d}:00")), (0x9011, *text("+00:00"))] if number % 11 else []
    gps = [(1, *text("N")), (2, *ratio(37, 1, number % 60, 1, 0, 1)), (3, *text("W")), (4, *ratio(127, 1, 30, 1, 0, 1))] if number % 3 else []
    thumb = [(0x0201, *long(800)), (0x0202, *long(4))] if number % 5 else []
    out = b"II*\0" + struct.pack("<I", 8)
    for at, raw in ((8, block(8, main, 700)), (300, block(300, taken)), (500, block(500, gps)), (700, block(700, thumb)), (800, b"\xff\xd8TH")):
        out = out.ljust(at, b"\0") + raw
    body = b"Exif\0\0" + out
    # A large segment before the camera's own, so that the first bytes don't hold it in every second file.
    padding = b"\xff\xe2" + struct.pack(">H", 60_002) + b"\0" * 60_000 if number % 2 else b""
    return b"\xff\xd8" + padding + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2pixels"


def _photo_files(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                numbers = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([f"job/photos/original/p{n}.jpg" for n in numbers]), pa.array([exif_photo(n) for n in numbers], pa.binary())], ["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")


@query(
    """WITH p AS (SELECT page_id AS n, page_id % 7 > 0 AND page_id % 9 > 0 AS readable FROM pages)
SELECT 'photo ' || n AS original_filename, CASE WHEN readable AND n % 5 > 0 THEN 'job/photos/thumbnail/p' || n || '_thumb.jpg' END AS thumbnail_path, 'https://cdn.example/job/photos/original/p' || n || '.jpg' AS url,
  CASE WHEN readable AND n % 5 > 0 THEN 'https://cdn.example/job/photos/thumbnail/p' || n || '_thumb.jpg' END AS thumbnail_url, CASE WHEN readable AND n % 3 > 0 THEN round(37 + (n % 60) / 60.0, 9) END AS meta_lat,
  CASE WHEN readable AND n % 3 > 0 THEN -127.5::DOUBLE END AS meta_lon, CASE WHEN readable AND n % 11 > 0 THEN make_timestamp(2024, 1, n % 28 + 1, 19, n % 60, 0.0) END AS meta_timestamp,
  CASE WHEN readable THEN 'Maker Cam ' || n % 10 END AS device, CASE WHEN readable THEN (n % 8 + 1)::INT END AS orientation FROM p"""
)
def register_uploads(spark: SparkSession, d: str) -> DataFrame:
    """A photo file per page, every ninth of which is missing, registered with what the files say."""
    pages = tables.scan(spark, d, "pages").select("page_id")
    with scratch(spark) as kept:
        folder = new_folder(spark, "uploads")
        files.put_objects(_photo_files(pages.where("page_id % 9 > 0")), folder)
        infos = pages.select(F.concat(F.lit("photo "), "page_id").alias("filename"), F.concat(F.lit("job/photos/original/p"), "page_id", F.lit(".jpg")).alias("storage_path"), F.lit("given.jpg").alias("thumbnail_path"))
        found = photos.register_uploads(spark, infos, folder, 20_000, base_url="https://cdn.example/").drop("storage_path")
        return kept(found.withColumn("meta_lat", F.round("meta_lat", 9)), "uploads")


@query(
    """SELECT 'p' || n || '.jpg' AS original_name, CASE WHEN n % 7 > 0 THEN 'Maker Cam ' || n % 10 END AS device, CASE WHEN n % 7 > 0 AND n % 11 > 0 THEN epoch(make_timestamp(2024, 1, n % 28 + 1, 10, n % 60, 0.0)) END AS timestamp,
  n % 7 > 0 AND n % 5 > 0 AS has_thumbnail FROM (SELECT page_id AS n FROM pages)"""
)
def photo_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Whole files decoded to camera metadata; files that aren't photos give nulls."""
    with scratch(spark) as kept:
        folder = new_folder(spark, "metadata")
        files.put_objects(_photo_files(tables.scan(spark, d, "pages").select("page_id")), folder)
        found = photos.metadata(files.contents(spark, f"{folder}/job/photos/original"))
        return kept(found.select("original_name", "device", "timestamp", F.col("thumbnail").isNotNull().alias("has_thumbnail")), "metadata")


def _reply(number: int) -> bytes:
    if number % 10 == 9:
        return b"{no"
    status = ("completed", "failed", "started")[number % 3]
    body = {"request_id": f"e{number}", "task_id": f"t{number}", "status": status}
    body |= {"result": {"pdf_url": f"exports/{number}.pdf"}} if status == "completed" else {"error": f"why {number}"} if status == "failed" else {}
    return json.dumps(body, indent=1).encode()


@query(
    """SELECT page_id % 50 AS job_id, 'e' || page_id AS export_id, CASE page_id % 3 WHEN 0 THEN 'EXPORTED' ELSE 'FAILED' END AS status, CASE page_id % 3 WHEN 1 THEN 'why ' || page_id END AS error,
  CASE page_id % 3 WHEN 0 THEN 'exports/' || page_id || '.pdf' END AS pdf_path FROM pages WHERE page_id % 10 <> 9 AND page_id % 3 <> 2 AND page_id % 4 <> 1"""
)
def export_reply_stream(spark: SparkSession, d: str) -> DataFrame:
    """The export worker's replies as a stream of files, joined with the requests that are known, three of four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"{n}.json" for n in numbers]), pa.array([_reply(n) for n in numbers], pa.binary())], ["name", "content"])

    pages = tables.scan(spark, d, "pages").select("page_id")
    with scratch(spark) as kept:
        folder = new_folder(spark, "drop")
        files.put_objects(pages.mapInArrow(run, "name string, content binary"), folder)
        requests = pages.where("page_id % 4 <> 1").select(F.concat(F.lit("e"), "page_id").alias("export_id"), (F.col("page_id") % 50).alias("job_id"))
        return kept(callbacks.collected(callbacks.reply_stream(spark, folder), lambda batch: callbacks.as_events(batch, requests)), "events")


@query(
    """SELECT conv_id AS job_id, count(*) AS n_clusters, sum(n)::BIGINT AS n_photos FROM (SELECT conv_id, turn % 3 AS c, count(*) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1"""
)
def cluster_reply_stream(spark: SparkSession, d: str) -> DataFrame:
    """The clustering worker's replies as a stream of files, one per conversation, parsed by their schema."""
    turns = tables.scan(spark, d, "conversations").groupBy("conv_id", (F.col("turn") % 3).alias("id")).agg(F.collect_list(F.struct(F.concat_ws("-", "conv_id", "turn").alias("path"))).alias("photos"))
    replies = turns.groupBy("conv_id").agg(F.collect_list(F.struct("id", "photos")).alias("clusters"))
    body = F.to_json(F.struct(F.col("conv_id").cast("string").alias("request_id"), F.lit("completed").alias("status"), F.struct("clusters").alias("result")))
    with scratch(spark) as kept:
        folder = new_folder(spark, "drop")
        files.put_objects(replies.select(F.concat("conv_id", F.lit(".json")).alias("name"), F.encode(body, "UTF-8").alias("content")), folder)
        found = callbacks.collected(callbacks.reply_stream(spark, folder, "cluster_result").where("readable").select("request_id", "result"))
        sizes = F.aggregate("result.clusters", F.lit(0).cast("long"), lambda s, c: s + F.size(c["photos"]))
        return kept(found.select(F.col("request_id").cast("long").alias("job_id"), F.size("result.clusters").cast("long").alias("n_clusters"), sizes.alias("n_photos")), "replies")
