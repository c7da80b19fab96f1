"""Dense order within a parent: insert and renumber, open and close gaps, append, take the first few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_at(rows: DataFrame, moves: DataFrame, parent: str = "cluster_id", key: str = "photo_id", counted: Column | None = None) -> DataFrame:
    """``rows`` with the moved one of each parent put at ``to_index`` and the parent's rows numbered from 0.

    ``moves`` has one row per parent: ``parent, key, to_index``; an index below 0 counts as 0, one past the end or null appends. Parents
    without a move stay as they are. The moved row may come from another parent, whose numbers keep their hole. Rows that aren't ``counted`` hold no
    place and keep their number, unless they are moved themselves.
    """
    m = moves.select(F.col(parent).alias("_parent"), F.col(key).alias("_key"), "to_index")
    placed = rows.join(m.select("_key", F.col("_parent").alias("_into")), rows[key] == F.col("_key"), "left").withColumn(parent, F.coalesce("_into", parent)).drop("_key", "_into")
    both = placed.join(m, placed[parent] == F.col("_parent"), "left")
    is_moved = F.coalesce(F.col(key) == F.col("_key"), F.lit(False))
    both = both.withColumns({"_moved": is_moved, "_in": F.lit(True) if counted is None else is_moved | counted})
    others = Window.partitionBy(parent, "_in").orderBy("_moved", F.col("order_index").asc_nulls_last(), key)
    rank = F.row_number().over(others) - 1
    n = F.count(F.when(~F.col("_moved"), 1)).over(Window.partitionBy(parent, "_in"))
    target = F.greatest(F.lit(0), F.least(F.coalesce("to_index", "_n"), F.col("_n"))) - F.lit(0.5)
    spot = F.when(F.col("_moved"), target).otherwise(F.col("_rank").cast("double"))
    numbered = both.withColumns({"_rank": rank, "_n": n}).withColumn("_spot", spot)
    new = F.row_number().over(Window.partitionBy(parent, "_in").orderBy("_spot")) - 1
    return numbered.withColumn("order_index", F.when(F.col("_parent").isNotNull() & F.col("_in"), new).otherwise(F.col("order_index")).cast("int")).select(*rows.columns)


def open_gap(rows: DataFrame, at: Column, parent: str) -> DataFrame:
    """Rows from ``at`` on move up by one; ``at`` is clamped to 0 and the parent's number of rows."""
    n = F.count("*").over(Window.partitionBy(parent))
    k = F.greatest(F.lit(0), F.least(at, n))
    return rows.withColumn("_k", k).withColumn("order_index", F.when(F.col("order_index") >= F.col("_k"), F.col("order_index") + 1).otherwise(F.col("order_index")).cast("int")).drop("_k")


def close_gap(rows: DataFrame, removed: DataFrame, parent: str) -> DataFrame:
    """Rows behind the removed place of their parent move down by one; ``removed`` has ``parent, removed_index``, one per parent."""
    both = rows.join(removed.select(parent, "removed_index"), parent, "left")
    moved = F.when(F.col("order_index") > F.col("removed_index"), F.col("order_index") - 1).otherwise(F.col("order_index"))
    return both.withColumn("order_index", moved.cast("int")).select(*rows.columns)


def append(rows: DataFrame, new: DataFrame, parent: str, key: str) -> DataFrame:
    """``new`` rows numbered on from the number of rows that their parent has, deleted ones included; null parents start at 0."""
    counts = rows.groupBy(parent).agg(F.count("*").alias("_start"))
    place = F.row_number().over(Window.partitionBy(parent).orderBy("seq", key)) - 1
    return new.join(counts, parent, "left").withColumn("order_index", (F.coalesce("_start", F.lit(0)) + place).cast("int")).drop("_start")


#: Labels of a report's three photos, before, during and after the work.
REPORT_ROWS = ("전", "중", "후")


def first_three(photos: DataFrame) -> DataFrame:
    """The first three photos of each cluster with the label of their report row."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("order_index").asc_nulls_last(), "photo_id")
    numbered = photos.withColumn("row", F.row_number().over(order)).where("row <= 3")
    return numbered.withColumn("label", F.element_at(F.array(*[F.lit(x) for x in REPORT_ROWS]), F.col("row")))
