"""Tables of the job model over the Parquet tables of a data folder, and rows looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: So many rows of few columns are dealt to a task.
PART_ROWS = 500_000


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def users(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("company_name"))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "CREATED").otherwise("PENDING")
    return scan(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), status.alias("status"), F.col("o_orderdate").alias("created_at")
    )


def cluster_key(job: Column, supplier: Column) -> Column:
    return F.concat_ws("-", job.cast("string"), supplier.cast("string"))


def photos(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return scan(spark, folder, "lineitem").select(
        F.concat_ws("-", *[c(x).cast("long").cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]).alias("photo_id"),
        c("l_orderkey").alias("job_id"),
        cluster_key(c("l_orderkey"), c("l_suppkey")).alias("cluster_id"),
        c("l_linenumber").alias("order_index"),
        F.when(c("l_returnflag") == "R", c("l_shipdate")).alias("deleted_at"),
        F.when(c("l_linestatus") == "F", c("l_shipdate")).alias("meta_timestamp"),
        F.concat(F.lit("photos/original/"), c("l_partkey"), F.lit(".jpg")).alias("storage_path"),
        F.when(c("l_tax") > 0.02, F.concat(F.lit("photos/thumbnail/"), c("l_partkey"), F.lit("_thumb.jpg"))).otherwise(F.lit("")).alias("thumbnail_path"),
    )


def parts(rows: DataFrame) -> int:
    """Into how many parts a table is dealt out by job. Tables dealt out into the same number meet without being moved again; over a scan, counting reads no column."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """One per supplier of an order; the first of every seventh order is the reserve cluster."""
    rows = scan(spark, folder, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_suppkey")
    # Dealt out by job once, for the distinct and the numbering. The number of parts follows the rows: adaptive execution joins parts by their compressed bytes, and so few columns compress
    # so well that a task would hold many million rows.
    pairs = rows.repartition(parts(rows), "job_id").distinct()
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("l_suppkey")) - 1
    reserve = (F.col("place") == 0) & (F.col("job_id") % 7 == 0)
    return pairs.withColumn("place", place).select(
        cluster_key(F.col("job_id"), F.col("l_suppkey")).alias("cluster_id"),
        "job_id",
        F.when(reserve, "reserve").otherwise(F.concat(F.lit("cluster "), F.col("l_suppkey"))).alias("name"),
        F.when(reserve, -1).otherwise(F.col("place")).cast("int").alias("order_index"),
    )


def exports(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "PROCESSING").when(kind == "purchase", "EXPORTED").when(kind == "error", "FAILED").otherwise("PENDING")
    return scan(spark, folder, "events").select(
        F.col("event_id").alias("export_id"),
        F.col("user_id").alias("job_id"),
        status.alias("status"),
        F.when(kind != "click", F.col("ts")).alias("created_at"),
        F.when(kind.isin("purchase", "error"), F.col("ts")).alias("finished_at"),
        F.when(kind == "purchase", F.concat(F.lit("exports/"), F.col("event_id"), F.lit(".pdf"))).alias("pdf_path"),
    )


def by_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in a table of keys; for one key, filter instead."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def unique(rows: DataFrame, column: str) -> DataFrame:
    """The rows, if no key occurs twice; else the query stops and names one. Counts are joined, so no key is gathered in one task."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"more than one row with {column} "), F.col(column).cast("string"))).cast("string"))
    return rows.join(counts.withColumn("_bad", checked).select(column, "_bad"), column).where("_bad is null").select(*rows.columns)
