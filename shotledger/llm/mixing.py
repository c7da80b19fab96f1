"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Training time runs from 0 to 1. Each source has a schedule: one weight for each of ``len(schedule)`` equal phases. The
integral of the schedule is the source's weight, from which its target follows; the running integral, scaled to the target, is
the source's cumulative demand ``D(t)`` in words. Documents of a source stand in the order of a hash; a copy that takes the
source's words ``c .. c + size`` is trained on at the position ``t`` where ``D(t)`` reaches the middle of that span, so the
inverse of the demand spreads copies as the schedule asks. ``training_order`` range-sorts all copies by position; ``scheduled`` gives each
document the positions of its copies and their ranks in that order.

Targets: sources share the words of all documents by weight, but none gets more than ``max_epochs`` times its own words; the
excess is shared by weight among the others until none is above. Sources are ordered by code point, null last.

Whole epochs first: every document is taken ``floor(target / words)`` times. For what is left, ``r`` words, documents are
taken once more in hash order while they fit wholly; of the others, the one whose size is nearest to the gap is added if
that brings the sum nearer. So taken words differ from the target by less than one document.

No task holds a whole source: running sums are taken within hash buckets of about ``rows_per_bucket`` rows and shifted by the sums of
the buckets before. Only the table of (source, bucket) sums is sorted as a whole per source.

Defined results: a null text has size 0; documents of size 0 are taken as often as their source's whole epochs; a null source
is a source of its own; repeated rows count each; a source without words has target 0; extra columns stay out of the way because all
work is done on renamed columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotledger.sources.shared import materialise, scratch

#: Relative weight in each phase of training; early phases favour the sources at odd places of the order.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t \\n \\v \\f \\r; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """From one row per source (``source``, ``source_size``) its weight, target and schedule.

    The window without a key runs over one row per source, never over documents.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(place) - 1
    phases = F.array(*[F.array(*[F.lit(float(w)) for w in s]) for s in schedules])
    # Times in which sources are capped: those with the least cap for their weight first.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weighed = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
        .withColumn("schedule", F.element_at(phases, (rank % len(schedules) + 1).cast("int")))
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    )
    levels = (
        weighed.withColumn("total", F.sum(F.col("source_size").cast("double")).over(all_rows))
        .withColumn("all_weight", F.sum("weight").over(all_rows))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))))
        # The first source that isn't capped fixes the level of all that follow.
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "weight", "schedule", target.alias("target"))


def _position(words: Column, target: Column, schedule: Column) -> Column:
    """Where in training the demand of a source reaches ``words``: the inverse of the running integral of its schedule."""
    share = words / target
    whole = F.aggregate(schedule, F.lit(0.0), lambda a, w: a + w)
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0.0).alias("t"))
    step = 1.0 / F.size(schedule)

    def phase(a: Column, w: Column) -> Column:
        part = w / whole
        inside = F.when(w > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - a["done"]) / part))).otherwise(F.when(share > a["done"], 1.0).otherwise(0.0))
        return F.struct((a["done"] + part).alias("done"), (a["t"] + inside * step).alias("t"))

    return F.aggregate(schedule, start, phase)["t"]


def curriculum(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, schedules: Sequence[Sequence[float]] = SCHEDULES, rows_per_bucket: int = 4096, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, weight, target, copies, taken, positions`` and the columns in ``keep``.

    ``positions`` has one training position per copy. Columns in ``keep`` are carried through the shuffles, so leave texts out
    where only the plan is needed.
    """
    extra = [F.col(f"`{c}`").alias(f"keep_{c}") for c in keep]
    sized = materialise(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")))))).alias("key"), *extra),
        "sizes",
    )
    n_buckets = 16 ** max(0, math.ceil(math.log(max(1, sized.count()) / rows_per_bucket, 16)))
    digits = round(math.log(n_buckets, 16))
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs, schedules)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = materialise(
        by_bucket.withColumn("shift", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .withColumnsRenamed({"source": "source_", "bucket": "bucket_"})
        .join(targets.withColumnRenamed("source", "source_t"), F.col("source_").eqNullSafe(F.col("source_t")))
        .drop("source_t", "bucket_size"),
        "plan",
    )
    line = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    within = line.rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = (
        sized.withColumns({"own": F.coalesce(F.sum("size").over(within), F.lit(0)), "nth": F.row_number().over(line)})
        .join(plan, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bucket") == F.col("bucket_")))
        .drop("source_", "bucket_", "bucket")
        .withColumn("start", F.col("own") + F.col("shift"))
        .drop("own", "shift")
        .withColumn("epochs", epochs.cast("int"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("more", (F.col("size") > 0) & (F.col("start") + F.col("size") <= F.col("rest")))
    )
    placed = materialise(placed, "placed")
    gaps = placed.groupBy("source").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("more"), F.col("size"))), F.lit(0))).alias("gap"))
    gaps = gaps.select(F.col("source").alias("source_"), "gap")
    # One row per source; left to Spark's own size check whether to broadcast.
    joined = placed.join(gaps, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    off = F.abs(F.col("gap") - F.col("size"))
    fits = ~F.col("more") & (F.col("size") > 0) & (off < F.col("gap"))
    # Equal rows differ by their number within the bucket, which the key names, so one row is added and not its copies too.
    best = joined.where(fits).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "doc_id", "size", "nth")).alias("best"))
    best = materialise(best.select(F.col("source").alias("source_"), "best"), "best")
    final = joined.join(best, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    added = F.coalesce((F.col("best.key") == F.col("key")) & (F.col("best.nth") == F.col("nth")) & ~F.col("more"), F.lit(False))
    copies = F.col("epochs") + F.when(F.col("more") | added, 1).otherwise(0)
    # Rounded, so that positions don't hang on the order in which a target was summed.
    demand = F.round("target", 6)
    middle = lambda i: F.least(demand, i * F.col("source_size") + F.col("start") + F.col("size") / 2.0)
    return (
        final.withColumn("copies", copies)
        .withColumn("positions", F.when((F.col("copies") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda i: _position(middle(i), demand, F.col("schedule")))).otherwise(F.array().cast("array<double>")))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "weight", "target", "copies", "taken", "positions", *[F.col(f"keep_{c}").alias(f"keep_{c}") for c in keep])
    )


def training_order(planned: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position; documents that no epoch takes are left out."""
    return planned.select("*", F.posexplode("positions").alias("copy", "position")).orderBy("position", "source", "doc_id", "copy")


def scheduled(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document, also of those that aren't taken: ``doc_id, size, source, source_size, target, taken, positions, ranks``.

    All copies are put in training order; ``taken`` is summed over a document's copies there, and ``ranks`` are their places in it, from 0.
    """
    with scratch(docs.sparkSession) as kept:
        return kept(_scheduled(docs, **options), "scheduled")


def _scheduled(docs: DataFrame, **options: object) -> DataFrame:
    plan = materialise(curriculum(docs, **options).withColumn("row", F.monotonically_increasing_id()), "planned")
    ordered = training_order(plan.select("row", "doc_id", "source", "size", "positions"))
    # A row's number in its partition stands in the lower 33 bits; partitions stand in training order.
    ordered = materialise(ordered.select("row", "size", "copy", "position", F.monotonically_increasing_id().alias("at")), "order")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = ordered.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))
    found = ranked.groupBy("row").agg(F.sum("size").alias("all_taken"), F.array_sort(F.collect_list(F.struct("copy", "position", "rank"))).alias("found"))
    return plan.join(found, "row", "left").select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        F.coalesce("all_taken", F.lit(0)).alias("taken"),
        F.coalesce(F.col("found.position"), F.array().cast("array<double>")).alias("positions"),
        F.coalesce(F.col("found.rank"), F.array().cast("array<bigint>")).alias("ranks"),
    )


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted by training position.

    The plan is made without texts and joined to them once, by id; rows whose ids aren't unique are written with a number for that.
    """
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"keep_{c}") for c in names])
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    with scratch(docs.sparkSession) as kept:
        if repeated:
            rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        else:
            rows = rows.withColumn("row", F.col("keep_doc_id"))
        plan = curriculum(rows.select("row", *[F.col(f"keep_{c}").alias(c) for c in ("doc_id", "source", "text")]), keep=("row",), **options)
        plan = kept(plan.where(F.size("positions") > 0).select(F.col("keep_row").alias("planned_row"), "positions"), "plan")
    taken = rows.join(plan, F.col("row").eqNullSafe(F.col("planned_row")))
    copies = taken.select(*[F.col(f"keep_{c}") for c in names], F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "keep_source", "keep_doc_id", "copy").select(*[F.col(f"keep_{c}").alias(c) for c in names])


def oracle_sql() -> str:
    """What each document is taken and when, as SQL: the targets by repeated resharing, the rest by running sums over whole sources, positions phase by phase."""
    word = r"[^\x20\x09-\x0D]+"

    def position(schedule: Sequence[float]) -> str:
        whole, done, t = sum(schedule), "0.0::DOUBLE", "0.0::DOUBLE"
        for w in schedule:
            part = f"({w}::DOUBLE / {whole}::DOUBLE)"
            t = f"({t} + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (share - {done}) / {part})) * (1.0::DOUBLE / {len(schedule)}))"
            done = f"({done} + {part})"
        return t

    positions = " ".join(f"WHEN {k} THEN {position(schedule)}" for k, schedule in enumerate(SCHEDULES))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{word}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS key,
                            row_number() OVER () AS r FROM documents),
s0 AS (SELECT coalesce(source, '') AS sk, source IS NULL AS sn, sum(size)::BIGINT AS ss FROM d GROUP BY 1, 2),
s AS (SELECT *, ((row_number() OVER (ORDER BY sn, sk) - 1) % 3 + 1)::DOUBLE AS w, (row_number() OVER (ORDER BY sn, sk) - 1) % {len(SCHEDULES)} AS sched FROM s0),
tot AS (SELECT sum(ss)::DOUBLE AS t FROM s),
it AS (SELECT 0 AS n, sk, sn, ss, w, false AS capped, t * w / sum(w) OVER () AS target FROM s, tot
       UNION ALL
       SELECT n + 1, sk, sn, ss, w, c, CASE WHEN c THEN 3.0 * ss ELSE (t - sum(CASE WHEN c THEN 3.0 * ss ELSE 0 END) OVER ()) * w / sum(CASE WHEN c THEN 0 ELSE w END) OVER () END
       FROM (SELECT *, capped OR target > 3.0 * ss AS c FROM it), tot WHERE n < (SELECT count(*) FROM s)),
g AS (SELECT sk, sn, ss, target, CASE WHEN ss > 0 THEN floor(target / ss + 1e-12) ELSE 0 END AS ep FROM it WHERE n = (SELECT max(n) FROM it)),
p AS (SELECT d.*, g.*, target - ep * ss AS rest,
             coalesce(sum(size) OVER (PARTITION BY sk, sn ORDER BY key, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON coalesce(d.source, '') = g.sk AND (d.source IS NULL) = g.sn),
m AS (SELECT *, size > 0 AND start + size <= rest AS more FROM p),
gap AS (SELECT *, rest - coalesce(sum(CASE WHEN more THEN size END) OVER (PARTITION BY sk, sn), 0) AS gap FROM m),
b AS (SELECT *, CASE WHEN NOT more AND size > 0 AND abs(gap - size) < gap
                     THEN row_number() OVER (PARTITION BY sk, sn, NOT more AND size > 0 AND abs(gap - size) < gap ORDER BY abs(gap - size), key, doc_id) END AS k FROM gap),
t AS MATERIALIZED (SELECT b.*, sched, (ep + CASE WHEN more OR coalesce(k, 0) = 1 THEN 1 ELSE 0 END)::INT AS copies FROM b JOIN (SELECT sk, sn, sched FROM s) USING (sk, sn)),
c AS (SELECT r, doc_id, source, copy, CASE sched {positions} END AS position FROM
  (SELECT r, doc_id, source, sched, copy, least(round(target, 6), (copy * ss + start)::DOUBLE + size / 2.0::DOUBLE) / round(target, 6) AS share FROM (SELECT *, unnest(range(0, copies)) AS copy FROM t WHERE target > 0))),
o AS (SELECT r, list(position ORDER BY copy) AS positions, list(nth ORDER BY copy) AS ranks FROM
  (SELECT *, row_number() OVER (ORDER BY position, source NULLS FIRST, doc_id NULLS FIRST, copy) - 1 AS nth FROM c) GROUP BY 1)
SELECT doc_id, size, ss AS source_size, target, size * copies AS taken, coalesce(positions, []) AS positions, coalesce(ranks, []) AS ranks FROM t LEFT JOIN o USING (r)"""
