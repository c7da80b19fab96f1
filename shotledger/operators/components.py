"""Connected components of links as rounds of joins and aggregations; no step holds a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.sources.shared import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a`` and ``b`` of one type); nodes share a root if links join them.

    Each round contracts every node into the least of its neighbours and itself, by hash, so that the links left shrink by a
    constant factor whatever the shape of the graph; roots are any node of the component. Links with a null end are ignored.
    """
    left = materialise(links.select("a", "b").where("a != b"), "links")
    steps: list[DataFrame] = []
    while True:
        both = left.union(left.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        step = materialise(least.select(F.col("a").alias("node"), F.least("m", own)["n"].alias("root")), "step")
        steps.append(step)
        for end in ("a", "b"):
            left = left.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        left = materialise(left.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if left.isEmpty():
            break
    found = steps[0]
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
