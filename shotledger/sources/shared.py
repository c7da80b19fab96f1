"""Tables written to the folder that the driver and all executors share.

``checkpoint()`` computes its input twice unless it is persisted; a written Parquet table computes it once, keeps only
the columns asked for, and survives the loss of any executor, so the operators cut lineage with these tables. An operator that needs
many of them works in a ``scratch``: what it doesn't keep is deleted when it is done.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths written in each scratch open in this thread, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("_open", default=())
#: Spark's setting that deletes the shuffle files of a query when it has ended; a written table doesn't need them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limits for tables that it broadcasts by itself: by the size of their files, and by that of rows that were shuffled.
GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: The most bytes of a table that is broadcast on purpose.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shotledger-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str, depth: int = -1) -> str:
    """A path in the shared folder that no other call gets; it goes with the scratch it is made in."""
    path = f"{shared_dir(spark)}/shotledger-{uuid.uuid4().hex}/{name}"
    if len(_open.get()) >= -depth:
        _open.get()[depth].append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Spark's settings have these values for queries and streams that begin inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cleaned(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that end inside leave no shuffle files."""
    return settings(spark, {CLEANUP: "true"})


def sized_broadcasts(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries that begin inside broadcast only what was measured while they run. What the planner guesses by the bytes of packed files can be a tenth of the rows, and the driver holds them all."""
    most = spark.conf.get(MEASURED, None) or spark.conf.get(GUESSED)
    return settings(spark, {GUESSED: "-1", MEASURED: most})


def materialise(df: DataFrame, name: str, depth: int = -1) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of what was written; it goes with the scratch it is written in."""
    path = new_folder(df.sparkSession, name, depth)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_folder`` gave, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])  # noqa: SLF001
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001


def release(table: DataFrame) -> None:
    """Delete what an operator wrote for the table that it returned, once nobody reads it any more; tables that aren't ours stay."""
    spark = table.sparkSession
    home = shared_dir(spark).removeprefix("file:").lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        plain = folder.removeprefix("file:").lstrip("/")
        if plain.startswith(f"{home}/shotledger-") and plain.count("/") == home.count("/") + 2:
            delete(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the tables that are written inside when it ends. What it gives writes a table that stays, or goes with the scratch around this one."""
    before = _open.set((*_open.get(), []))
    try:
        yield lambda df, name: materialise(df, name, -2)
    finally:
        paths = _open.get()[-1]
        _open.reset(before)
        for path in paths:
            delete(spark, path)


def size_in_bytes(table: DataFrame) -> int:
    """Bytes of the values of a written table: those of fixed size by their type, texts, binaries and arrays by their length."""
    each = F.lit(0).cast("long")
    for f in table.schema:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            own = F.octet_length(col)
        elif kind in ("array", "map", "struct", "variant"):
            own = F.octet_length(F.to_json(F.struct(col)))
        else:
            own = F.lit(16)
        each = each + F.coalesce(own.cast("long"), F.lit(0)) + 16
    return table.agg(F.sum(each)).first()[0] or 0


def broadcast_if_small(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table marked for broadcast if its values take no more than ``most`` bytes; beyond that joins shuffle it."""
    return F.broadcast(table) if size_in_bytes(table) <= most else table
