"""Folders of files: listings by suffix, whole and partial contents, JSON and text in and out, requests as JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Suffixes of the photos that are taken.
PHOTO_SUFFIXES = ("png", "jpg", "jpeg")


def is_photo(path: Column) -> Column:
    found = F.lit(False)
    for suffix in PHOTO_SUFFIXES:
        found = found | F.lower(path).endswith(suffix)
    return found


def list_photos(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the photos right in a folder; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return found.where(is_photo(F.col("path"))).select("path", "length")


def contents(spark: SparkSession, folder: str, first_bytes: int | None = None) -> DataFrame:
    """``path, content``; with ``first_bytes`` of n, bytes 0 to n, both included, and no more is read."""
    files = spark.read.format("binaryFile").load(folder)
    if first_bytes is None:
        return files.select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            heads = []
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))
                with store.open_input_file(name) as stream:
                    heads.append(stream.read(first_bytes + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], ["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content binary")


def put_objects(rows: DataFrame, folder: str) -> int:
    """Write each row's ``content`` as a file ``name`` below the folder, from the tasks; gives the number of files. A task that is run again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder))
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def below(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects below a folder."""
    return objects.where(F.col("path").startswith(prefix.rstrip("/") + "/"))


def outside(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects left when all below a folder are deleted."""
    return objects.where(~F.col("path").startswith(prefix.rstrip("/") + "/"))


def scheme_of(path: Column) -> Column:
    """``local`` or ``gcs`` by the path's scheme; another one stops the query."""
    scheme = F.regexp_extract(path, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    unknown = F.raise_error(F.concat(F.lit("no storage for "), scheme)).cast("string")
    return F.when(scheme.isin("", "file"), "local").when(scheme.isin("gs", "gcs"), "gcs").otherwise(unknown)


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """JSON documents, or one per line; a document that isn't JSON stops the query."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that isn't empty; a listing passes empty files over."""
    return spark.read.text(path, wholetext=True)


def read_paths(paths: DataFrame) -> DataFrame:
    """``path, value`` of the named files as texts; an empty JSON file reads as ``{}``, another empty one as the empty text; a missing one stops the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            texts = []
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))
                with store.open_input_file(name) as stream:
                    text = stream.read().decode()
                texts.append(text or ("{}" if path.lower().endswith(".json") else ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "value"])

    return paths.select("path").mapInArrow(run, "path string, value string")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("errorifexists").text(path)


def as_requests(rows: DataFrame, *columns: str) -> DataFrame:
    """The JSON body of a request per row, null fields left out."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "true"}).alias("body"))


def log_records(rows: DataFrame, time: Column, level: Column, message: Column) -> DataFrame:
    """Log lines as JSON; lines about the metrics route are left out."""
    fields = F.struct(F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("time"), level.alias("level"), message.alias("message"))
    return rows.where(~F.coalesce(message.contains("/metrics"), F.lit(False))).select("*", F.to_json(fields, {"ignoreNullFields": "true"}).alias("record"))
