"""Views kept up with edits: what an edit changed goes into the view by a rule, and nothing else is computed anew.

Counts and histograms follow by sums: rows before the edit are taken off, rows after it are added. Nested views follow by job: those of the jobs that the edit touched are made again from
these jobs' rows. Over tables in a ``versions.Store`` only the touched jobs' buckets are read and written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.sources.shared import BROADCAST_BYTES, materialise, size_in_bytes
from shotledger.sources.versions import Store, Transaction, bucket


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows that differ between two states of a table or stand in one only, with ``sign``: -1 as they were, 1 as they are. Keys are unique and not null."""
    a = before.select(F.col(key), F.struct(*before.columns).alias("_was"))
    b = after.select(F.col(key), F.struct(*before.columns).alias("_is"))
    differ = a.join(b, key, "full").where(~F.col("_was").eqNullSafe(F.col("_is")))
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("_was").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("_is").alias("r"))))
    return differ.select(sides.alias("s")).where("s.r is not null").select("s.r.*", "s.sign")


def follow_sums(view: DataFrame, changed: DataFrame, group: str, sums: Sequence[str]) -> DataFrame:
    """A view of sums per group after changes: ``changed`` has ``group``, ``sign`` and what each row adds to every sum; the first of the sums counts rows, and groups without rows go."""
    delta = changed.groupBy(group).agg(*[F.sum(F.col(s) * F.col("sign")).alias(s) for s in sums])
    both = view.select(group, *sums).unionByName(delta.select(group, *sums))
    return both.groupBy(group).agg(*[F.sum(s).alias(s) for s in sums]).where(F.col(sums[0]) > 0)


def follow_groups(view: DataFrame, touched: DataFrame, make: Callable[..., DataFrame], *tables: DataFrame, key: str = "job_id") -> DataFrame:
    """A view with one row per key after an edit of the keys in ``touched``: theirs are made by ``make`` from the tables' rows of these keys, the others stay."""
    keys = touched.select(key).distinct()
    made = make(*[t.join(keys, key, "left_semi").select(*t.columns) for t in tables])
    return view.join(keys, key, "left_anti").select(*view.columns).unionByName(made.select(*view.columns))


def standing(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """A written table of keys for joins with rows of some buckets, what is done to the rows before, and to those with a key after.

    Keys that may be broadcast leave the rows where they stand in their buckets' files, and only those with a key are dealt out. Others are dealt out with the rows.
    """
    deal, stay = lambda rows: rows.repartition(n, key), lambda rows: rows
    return (F.broadcast(keys), stay, deal) if size_in_bytes(keys) <= BROADCAST_BYTES else (deal(keys), deal, stay)


def follow_in_store(t: Transaction, store: Store, view: str, touched: DataFrame, make: Callable[..., DataFrame], *tables: str) -> list[int]:
    """The same over a store whose tables and view lie in buckets of one key, as part of the edit's own transaction; gives the buckets that were read and written.

    Tables that the transaction has changed are seen as they are after that. Buckets are followed some at a time; of these only the touched keys' rows are dealt out, by the key and once, and ``make`` groups and joins them where they are.
    """
    keys = materialise(touched.distinct(), "touched")
    some = store.buckets_of(view, keys, t.base)
    if some:
        key, n = store.layout(view, t.base)

        def made(part: list[int]) -> DataFrame:
            here, deal, then = standing(materialise(keys.where(bucket(F.col(key), n).isin(part)), "here"), key, n)
            return follow_groups(deal(t.read(view, part)), here, lambda *rows: make(*[then(r) for r in rows]), *[deal(t.read(x, part)) for x in tables], key=key)

        t.replace_buckets(view, made, some)
    return some
