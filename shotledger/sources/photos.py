"""Camera metadata out of photo files, and uploads registered with it.

The decoder reads the Exif block of a JPEG (or a bare TIFF header) as the public TIFF and Exif formats lay it out: rationals and texts as they
are written. What they mean is left to the column functions in ``functions.exif``. A file that can't be decoded gives nulls.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.functions import exif
from shotledger.functions import scalars as X

#: Fixed values of the formats: tag numbers by block, and bytes per value of each type.
MAIN = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "changed"}
EXIF = {
    0x829A: "exposure", 0x8827: "iso", 0x9003: "taken", 0x9011: "offset", 0x9209: "flash", 0x920A: "focal", 0x9291: "subsec", 0xA402: "exposure_mode", 0xA403: "white_balance",
    0xA404: "zoom", 0xA405: "focal_35mm", 0xA406: "scene",
}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt", 16: "way_ref", 17: "way"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

RATIONAL = pa.struct([("num", pa.int64()), ("den", pa.int64())])
FIELDS = {
    **{n: pa.string() for n in ("make", "model", "changed", "taken", "offset", "subsec", "lat_ref", "lon_ref", "way_ref")},
    **{n: pa.int32() for n in ("orientation", "iso", "flash", "exposure_mode", "white_balance", "focal_35mm", "scene", "alt_ref")},
    **{n: RATIONAL for n in ("exposure", "focal", "zoom", "alt", "way")},
    **{n: pa.list_(RATIONAL) for n in ("lat", "lon")},
    "thumbnail": pa.binary(),
}
_SPARK = {pa.string(): "string", pa.int32(): "int", RATIONAL: "struct<num: long, den: long>", pa.list_(RATIONAL): "array<struct<num: long, den: long>>", pa.binary(): "binary"}
SCHEMA = ", ".join(f"{n} {_SPARK[t]}" for n, t in FIELDS.items())


def exif_block(content: bytes) -> bytes | None:
    """The TIFF block of a JPEG's Exif segment."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        if kind == 0xDA:
            break
        at += 2 + size
    return None


def decode(content: bytes | None) -> dict:
    """The fields of ``FIELDS`` that the file has."""
    block = exif_block(content or b"")
    if block is None or len(block) < 8:
        return {}
    order = "<" if block[:2] == b"II" else ">"
    found: dict = {}

    def entries(at: int) -> tuple[list[tuple[int, int, int, int]], int]:
        n = struct.unpack_from(order + "H", block, at)[0]
        rows = [(*struct.unpack_from(order + "HHI", block, at + 2 + 12 * k), at + 10 + 12 * k) for k in range(n)]
        return rows, struct.unpack_from(order + "I", block, at + 2 + 12 * n)[0]

    def value(kind: int, count: int, at: int):
        if SIZES.get(kind, 1) * count > 4:
            at = struct.unpack_from(order + "I", block, at)[0]
        if kind == 2:
            return block[at : at + count].split(b"\0")[0].decode("utf-8", "replace")
        if kind in (5, 10):
            pairs = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", block, at)
            return [{"num": a, "den": b} for a, b in zip(pairs[::2], pairs[1::2])]
        if kind in (1, 3, 4, 7, 9):
            return struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B', 9: 'i'}[kind]}", block, at)[0]
        return None

    def take(rows, names) -> None:
        for tag, kind, count, at in rows:
            if tag in names and count:
                name, x = names[tag], value(kind, count, at)
                want = FIELDS[name]
                if want == RATIONAL:
                    x = x[0] if isinstance(x, list) else None
                elif want == pa.string():
                    x = x if isinstance(x, str) else None
                elif want == pa.int32():
                    x = x if isinstance(x, int) else None
                found[name] = x

    try:
        rows, following = entries(struct.unpack_from(order + "I", block, 4)[0])
        take(rows, MAIN)
        for tag, names in ((0x8769, EXIF), (0x8825, GPS)):
            for t, kind, count, at in rows:
                if t == tag:
                    take(entries(value(kind, count, at))[0], names)
        if following:
            places = {t: value(kind, count, at) for t, kind, count, at in entries(following)[0] if t in (0x0201, 0x0202)}
            if len(places) == 2:
                found["thumbnail"] = block[places[0x0201] : places[0x0201] + places[0x0202]]
    except (struct.error, IndexError, ValueError, TypeError):
        return {}
    return found


def raw_metadata(files: DataFrame) -> DataFrame:
    """``path`` and the decoded fields of each file in ``path, content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g.get(n) for g in got], t) for n, t in FIELDS.items())], ["path", *FIELDS])

    return files.select("path", "content").mapInArrow(run, f"path string, {SCHEMA}")


def metadata(files: DataFrame) -> DataFrame:
    """``described`` for the files in ``path, content``."""
    return described(raw_metadata(files))


def by_origin(paths: DataFrame) -> DataFrame:
    """``origin`` of each path: ``http`` for what is fetched over the network, which no Spark job does, else ``local``."""
    return paths.withColumn("origin", F.when(F.col("path").startswith("http"), "http").otherwise("local"))


def described(raw: DataFrame) -> DataFrame:
    """What the decoded fields mean: place, height, direction, epoch seconds and camera settings."""
    c = F.col
    lat, lon = exif.degrees(c("lat"), c("lat_ref")), exif.degrees(c("lon"), c("lon_ref"))
    rows = raw.withColumns({"_lat": lat, "_lon": lon, "_alt": exif.altitude(c("alt"), c("alt_ref")), "_way": exif.direction(c("way"), c("way_ref"))})
    there = lambda x: exif.located(c("_lat"), c("_lon"), c(x))
    return rows.select(
        "path", X.basename(c("path")).alias("original_name"), there("_lat").alias("lat"), there("_lon").alias("lon"), there("_alt").alias("alt"), there("_way").alias("gps_img_direction"),
        exif.epoch_seconds(c("taken"), c("subsec"), c("offset")).alias("timestamp"), F.nullif(F.trim(F.concat_ws(" ", "make", "model")), F.lit("")).alias("device"),
        exif.rational(c("focal")).alias("focal_length"), c("focal_35mm").cast("double").alias("focal_35mm"), exif.rational(c("exposure")).alias("exposure_time"), exif.rational(c("zoom")).alias("digital_zoom"),
        "iso", "flash", "orientation", c("scene").alias("scene_capture_type"), "white_balance", "exposure_mode", "thumbnail",
    )


def read_heads(paths: DataFrame, first_bytes: int) -> DataFrame:
    """``path`` and the decoded fields of each file in ``path``: from its first bytes, ``first_bytes`` and one more, and from the whole file only where these have no
    thumbnail or no time and place. Only as much is read; a file that can't be opened or decoded gives nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            got = []
            for path in batch.column(0).to_pylist():
                try:
                    store, name = fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/*", "file:///", path))
                    with store.open_input_file(name) as stream:
                        found = decode(stream.read(first_bytes + 1))
                        if "thumbnail" not in found or not {"taken", "lat"} & set(found):
                            stream.seek(0)
                            found = decode(stream.read()) or found
                except (OSError, pa.ArrowInvalid):
                    found = {}
                got.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g.get(n) for g in got], t) for n, t in FIELDS.items())], ["path", *FIELDS])

    return paths.select("path").mapInArrow(run, f"path string, {SCHEMA}")


def register_uploads(spark: SparkSession, infos: DataFrame, folder: str, first_bytes: int = 100 * 1024, fan_out: int = 10, base_url: str = "/") -> DataFrame:
    """Photos for uploaded files: ``infos`` has ``filename, storage_path, thumbnail_path``, the path below ``folder``.

    Every info gives a photo, also where the file is missing or can't be decoded, with nulls for what it should have said. The thumbnail's path is the derived one if the
    file holds a thumbnail, else null; one that was supplied doesn't stay. URLs are the paths behind ``base_url``. At most ``fan_out`` files are open at a time; the listing of the folder isn't needed.
    """
    base = folder if "://" in folder else f"file://{folder}"
    placed = infos.withColumn("path", F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("storage_path", "^/+", "")))
    found = described(read_heads(placed.select("path").distinct().repartition(fan_out, "path"), first_bytes))
    made = F.when(F.col("thumbnail").isNotNull(), X.thumbnail_path(F.col("storage_path"), F.lit(None).cast("string")))
    return placed.join(found, "path", "left").select(
        "storage_path", F.col("filename").alias("original_filename"), made.alias("thumbnail_path"), X.public_url(F.col("storage_path"), base_url).alias("url"), X.public_url(made, base_url).alias("thumbnail_url"),
        F.col("lat").alias("meta_lat"), F.col("lon").alias("meta_lon"), X.from_epoch(F.col("timestamp"), "Asia/Seoul").alias("meta_timestamp"), "device", "orientation",
    )
