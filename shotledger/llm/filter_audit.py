"""What each of several filters does in every order in which they can be applied, by counting paths through the lattice of their subsets.

A document is a set of filters that it fails. The state after some filters is the subset of them, an edge applies one more, and an order is a path from the
empty set to the whole one. What an edge removes depends on its state alone: the documents that fail the edge's filter and none of the state's.
So documents are counted once by what they fail, the counts go to the edges (``n * 2 ** (n - 1)`` of them), and no order is ever run.

- Forward counts say in how many orders a state is reached, backward counts in how many it is left to the end; their product is the number of orders that use an edge. Removals weighted by it
  are summed to a filter's Shapley numbers, over all orders.
- Each order's steps are read from the edges on its path.

Failing an earlier copy's filter needs the least id of each text: texts are hashed, the least id per hash is found by partial aggregation, and what is found is joined by
id, so that no text's copies meet in one task and no text is moved.

Defined results: a null text is empty; a null language is the empty one; several labels of one id count together (good if one says good, toxic if one says toxic); a null id has no
label, is no copy, and no row is a copy of it; rows repeated with one id aren't copies of each other, as no id is smaller; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.sources.shared import materialise, scratch

#: The most filters of an audit: the table of all orders has ``n * n!`` rows and is broadcast.
MOST_FILTERS = 7
SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: too few words, too many repeated words, too many capitals, special characters."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, SPACES), "")
    capitals = F.char_length(whole) - F.char_length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.char_length(whole).cast("long") * 3,
        "D": whole.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, good, toxic`` per document: ``failed`` has a bit for each of the filters A to E, from the lowest on."""
    checks = text_failures(F.col("text"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks.values())), F.lit(0))
    # Null ids join nothing; their rows are spread by where they were read.
    salt = F.when(F.col("doc_id").isNull(), F.spark_partition_id() + 1).otherwise(0)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    narrow = materialise(docs.select("doc_id", salt.alias("salt"), F.coalesce("lang", F.lit("")).alias("part"), bits.alias("bits"), digest.alias("digest")), "narrow")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    first = narrow.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.col("digest").alias("own"))
    # One id may be the first of several texts.
    first = first.groupBy("doc_id").agg(F.collect_set("own").alias("own"))
    both = narrow.join(said.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left").join(first.withColumn("salt", F.lit(0)), ["doc_id", "salt"], "left")
    copy = F.col("doc_id").isNotNull() & ~F.coalesce(F.array_contains("own", F.col("digest")), F.lit(False))
    failed = F.col("bits") + F.when(copy, 1 << len(checks)).otherwise(0)
    no = F.lit(False)
    return both.select("part", failed.alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each subset of ``n`` filters, in how many orders it is reached and in how many ways it is left for the whole set."""
    forward, backward = [0] * (1 << n), [0] * (1 << n)
    forward[0] = backward[-1] = 1
    for state in range(1 << n):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(1 << n)):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def edges(judgements: DataFrame, n: int) -> DataFrame:
    """Per part and edge (``state, filter``): ``kept, removed, redundant, unique_fails, good_lost, toxic_lost`` and ``paths``, the number of orders that use it."""
    forward, backward = path_counts(n)
    counted = judgements.groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n"))
    lattice = [(state, f, forward[state] * backward[state | 1 << f]) for state in range(1 << n) for f in range(n) if not state >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(p).cast("long").alias("paths")) for s, f, p in lattice]))
    at = counted.select("*", each.alias("e")).select("part", "failed", "good", "toxic", "n", "e.*")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails, before = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("state")) != 0
    total = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    return at.groupBy("part", "state", "filter", "paths").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("failed") == bit).alias("unique_fails"),
        total(fails & ~before & F.col("good")).alias("good_lost"),
        total(fails & ~before & F.col("toxic")).alias("toxic_lost"),
    )


def orders(names: Sequence[str]) -> pa.Table:
    """All orders of the filters as paths: ``filter_order, step, state, filter``."""
    rows = [("".join(names[f] for f in path), step + 1, sum(1 << f for f in path[:step]), path[step]) for path in itertools.permutations(range(len(names))) for step in range(len(names))]
    order, step, state, which = zip(*rows)
    return pa.table({"filter_order": pa.array(order), "step": pa.array(step, pa.int32()), "state": pa.array(state, pa.int32()), "filter": pa.array(which, pa.int32())})


def audit(judgements: DataFrame, names: Sequence[str]) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every part, order and step.

    ``judgements`` has ``part, failed, good, toxic`` per document, with a bit of ``failed`` for each of the ``names``, of one letter each.
    ``shapley`` is what the step's filter removes, summed over all orders; divided by ``len(names)!`` it is the filter's Shapley value.
    """
    if not 0 < len(names) <= MOST_FILTERS:
        raise ValueError(f"between one filter and {MOST_FILTERS}")
    spark = judgements.sparkSession
    with scratch(spark) as kept:
        found = materialise(edges(judgements, len(names)), "edges")
        shapley = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
        steps = found.drop("paths").join(F.broadcast(spark.createDataFrame(orders(names))), ["state", "filter"])
        counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
        return kept(steps.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *counts), "audit")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over documents, by language."""
    with scratch(docs.sparkSession) as kept:
        return kept(audit(judged(docs, labels), "ABCDE"), "audit")


def oracle_sql() -> str:
    """Every order run step by step over the documents' failures."""
    word = r"[^\x20\x09-\x0D]+"
    fails = "CASE substr(o.filter_order, {}, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"
    at = " ".join(f"WHEN {s} THEN {fails.format(s)}" for s in range(1, 6))
    gone = " OR ".join(f"(step > {s} AND {fails.format(s)})" for s in range(1, 5))
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
m AS (SELECT x, min(doc_id) AS first_id FROM t GROUP BY 1),
f AS MATERIALIZED (SELECT part, len(w) < 200 AS a, 100 * list_unique(w) < 50 * len(w) AS b, 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * len(x) AS c, regexp_matches(x, '[#$%&*|]') AS d,
  coalesce(t.doc_id > m.first_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM t JOIN m USING (x) LEFT JOIN l ON l.doc_id = t.doc_id),
g AS MATERIALIZED (SELECT part, a, b, c, d, e, good, toxic, count(*) AS n FROM f GROUP BY ALL),
z AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS z),
o AS (SELECT a.z || b.z || c.z || d.z || e.z AS filter_order FROM z a, z b, z c, z d, z e WHERE len(list_distinct([a.z, b.z, c.z, d.z, e.z])) = 5),
s AS (SELECT g.part, o.filter_order, step, n, good, toxic, CASE step {at} END AS fails, {gone} AS gone, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM r"""
