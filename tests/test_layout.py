"""Tables in buckets: what is read, and that nothing is moved."""

from __future__ import annotations

import re

import pytest

from shotledger.operators import relations
from shotledger.plans import catalog
from shotledger.sources import layout, tables
from tests.test_operators import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def laid(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with layout.Layout(spark, buckets=8) as found:
        for name in ("jobs", "clusters", "photos", "exports"):
            found.write(name, getattr(tables, name)(spark, SF))
        yield found
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_details_move_nothing(spark, laid):
    args = [laid.table(x) for x in ("jobs", "clusters", "photos", "exports")]
    found = layout.details_by_job(*args)
    assert "Exchange" not in plan(found)
    plain = relations.job_details(*[getattr(tables, x)(spark, SF) for x in ("jobs", "clusters", "photos", "exports")])
    assert "Exchange" in plan(plain)
    columns = ["job_id", "export_status", "clusters", "photos"]
    assert rows(found.select(*columns)) == rows(plain.select(*columns))
    assert "Exchange" not in plan(args[0].join(args[2], "job_id"))


def test_lookups_read_their_buckets(spark, laid):
    ids = spark.createDataFrame([(5,), (None,), (5,), (-1,)], "job int")
    found = laid.lookup("photos", ids)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't say how many
    chosen, of = map(int, re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan(laid.lookup("photos", ids))).groups())
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert of == 8 and chosen <= 2
    assert rows(found.select("photo_id")) == rows(laid.table("photos").where("job_id = 5").select("photo_id"))
    many = spark.range(layout.FILTER_IDS + 5)
    assert laid.lookup("photos", many).count() == laid.table("photos").where(f"job_id < {layout.FILTER_IDS + 5}").count()
    assert laid.lookup("photos", ids.limit(0)).count() == 0


def test_jobs_without_anything(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    clusters = spark.createDataFrame([("a", 1, "n", None), ("b", 1, "m", 0)], "cluster_id string, job_id long, name string, order_index int")
    photos = catalog.tables.photos(spark, SF).limit(0).select("photo_id", "job_id", "cluster_id", "order_index", "deleted_at", "storage_path", "thumbnail_path", "meta_timestamp")
    runs = catalog.tables.exports(spark, SF).limit(0)
    got = {r.job_id: ([c.cluster_id for c in r.clusters], r.photos, r.export_status) for r in layout.details_by_job(jobs, clusters, photos, runs).collect()}
    assert got == {1: (["b", "a"], [], "PENDING"), 2: ([], [], "PENDING")}


def test_buckets_grow_with_the_rows(spark):
    """A bucket is one task's, so a table of any size has few rows in each."""
    assert layout.buckets_for(spark.range(1000)) == 16
    assert layout.buckets_for(spark.range(16 * layout.BUCKET_ROWS + 1)) == 17
    assert layout.buckets_for(spark.range(216_000_000)) == 432
