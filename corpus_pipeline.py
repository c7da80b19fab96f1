"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, is written as Parquet to the shared folder, and is read again by the next.
SQL can't express the stages as they stand, so their tests compare them with brute force.

Null, empty and short texts are rejected by the first stage; null ids and sources, ties, repeated rows and empty tables pass through as the operators define it:
copies of a row are one document after the second stage, and an empty table gives no rows at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotledger.llm import jaccard, mixing, packing, quality, suffixes
from shotledger.sources.shared import materialise, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are taken out; documents that the rules reject go."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that similarity links join, the one with the least id stays."""
    return jaccard.one_per_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more stay only where they stand first."""
    return suffixes.cleaned(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as kept:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
        return kept(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
