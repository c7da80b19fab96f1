"""JSON documents of any shape: kept whole as variants, read by path, and written indented, one file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.sources import files


def parsed(text: Column) -> Column:
    """The document as a variant; null for what isn't JSON."""
    return F.try_parse_json(text)


def field(document: Column, path: str, kind: str = "string") -> Column:
    """A field by a path such as ``$.result.clusters[0].id``; null where the document has none, or has something else there that the type can't hold."""
    return F.try_variant_get(document, path, kind)


def with_fields(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the text column parsed to ``document``, ``is_json``, and a column for each of the fields (path and type). Unparsed texts stay as they are in their column."""
    kept = rows.withColumn("document", parsed(F.col(column))).withColumn("is_json", F.col("document").isNotNull())
    return kept.withColumns({name: field(F.col("document"), *spec) for name, spec in fields.items()})


def indented(document: Column) -> Column:
    """A struct, map, array or variant as JSON over several lines."""
    return F.to_json(document, {"pretty": "true"})


def write_documents(rows: DataFrame, name: Column, document: Column, folder: str) -> int:
    """One indented file per row, under its name below the folder; how many there are."""
    return files.put_objects(rows.select(name.alias("name"), F.encode(indented(document), "UTF-8").alias("content")), folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``path, value, document`` of every file below a folder; empty files aren't listed."""
    texts = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), "value", parsed(F.col("value")).alias("document"))
