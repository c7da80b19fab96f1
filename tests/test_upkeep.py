"""Views that follow edits, measured runs, documents of any shape, views of photos."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shotledger.operators import incremental, measure, relations, views
from shotledger.sources import documents, shared, tables
from shotledger.sources.versions import Store
from tests.test_operators import rows


def test_changes_and_sums(spark):
    schema = "id long, job_id long, size long"
    before = spark.createDataFrame([(1, 1, 5), (2, 1, None), (3, 2, 7), (4, 3, 1)], schema)
    after = spark.createDataFrame([(1, 1, 6), (2, 1, None), (4, 4, 1), (5, None, 2)], schema)
    changed = incremental.changes(before, after, "id")
    assert rows(changed.select("id", "job_id", "size", "sign")) == sorted([(1, 1, 5, -1), (1, 1, 6, 1), (3, 2, 7, -1), (4, 3, 1, -1), (4, 4, 1, 1), (5, None, 2, 1)], key=repr)
    view = lambda t: t.groupBy("job_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    delta = changed.select("job_id", "sign", F.lit(1).cast("long").alias("n"), F.coalesce("size", F.lit(0)).alias("size"))
    assert rows(incremental.follow_sums(view(before), delta, "job_id", ["n", "size"])) == rows(view(after))
    assert incremental.changes(before, before, "id").count() == 0


def test_a_view_after_many_edits(spark, tmp_path):
    """The view after fifteen edits equals the one made anew, and each edit reads and writes only the buckets of its jobs."""
    photos = spark.range(400).select(F.col("id").alias("photo_id"), (F.col("id") % 40).alias("job_id"), F.lit(0).alias("deleted"))
    make = lambda p: p.groupBy("job_id").agg(F.count("*").alias("n"), F.sum("deleted").alias("gone"))
    store = Store(spark, f"file://{tmp_path}/store")
    with store.transaction() as t:
        t.replace("photos", photos, by=("job_id", 16))
        t.replace("view", make(photos), by=("job_id", 16))
    for k in range(15):
        touched = spark.createDataFrame([(k,), (2 * k,)], "job_id long")
        some = store.buckets_of("photos", touched)
        with store.transaction() as t, shared.scratch(spark):
            hit = t.read("photos", some).withColumn("deleted", F.when((F.col("job_id").isin(k, 2 * k)) & (F.col("photo_id") % 3 == 0), 1).otherwise(F.col("deleted")))
            t.replace_buckets("photos", hit, some)
            assert incremental.follow_in_store(t, store, "view", touched, make, "photos") == some and len(some) <= 2
        assert set(store.entry(store.latest())["changed"]["view"]) == set(some)
    assert rows(store.read("view")) == rows(make(store.read("photos"))) and store.read("view").agg(F.sum("gone")).first()[0] > 60


def test_recorder(spark, tmp_path):
    recorder = measure.Recorder(spark, most=5)
    assert recorder.run("count", spark.range(7), lambda df: df.collect())[-1]["id"] == 6
    with pytest.raises(ZeroDivisionError):
        with recorder.task("fails"):
            1 / 0
    got = {r.task: r for r in recorder.rows().collect()}
    assert got["count"].n_rows == 7 and got["fails"].n_rows is None and got["count"].ended >= got["count"].began and got["count"].before > 0
    listener = recorder.listener()
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in/a")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in/*").writeStream.queryName("reads").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        stream.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert ("reads", 5) in {(r.task, r.n_rows) for r in recorder.rows().collect()}
    for _ in range(9):
        recorder.add("many", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 2), 0, 1 << 20, 1)
    assert [tuple(r)[:3] for r in relations.histogram(relations.deltas(recorder.rows()), "task", "seconds", (1.0, 5.0)).collect()] == [("many", 5, 10.0)]


def test_documents(spark, tmp_path):
    texts = ['{"a": {"b": [1, {"c": "x"}]}}', '{"a": 5}', "[1, 2]", "null", "{no", "", None, '{"a": {"b": [1, {"c": 7}]}, "more": {"k": null}}']
    data = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    fields = {"c": ("$.a.b[1].c", "string"), "first": ("$.a.b[0]", "int"), "a": ("$.a", "int"), "second": ("$[1]", "int")}
    got = {r.id: tuple(r)[1:] for r in documents.with_fields(data, "body", fields).orderBy("id").select("id", "is_json", *fields).collect()}
    assert got[0] == (True, "x", 1, None, None) and got[1] == (True, None, None, 5, None) and got[2] == (True, None, None, None, 2) and got[7] == (True, "7", 1, None, None)
    assert all(got[k] == (False, None, None, None, None) for k in (4, 5, 6)) and got[3][0]
    made = spark.createDataFrame([("x/1.json", [1, 2], "ä"), ("2.json", [], None)], "name string, numbers array<int>, t string")
    assert documents.write_documents(made, F.col("name"), F.struct("numbers", "t"), f"file://{tmp_path}/d") == 2
    assert (tmp_path / "d/x/1.json").read_text() == '{\n  "numbers" : [ 1, 2 ],\n  "t" : "ä"\n}'
    read = documents.read_documents(spark, f"{tmp_path}/d")
    assert sorted(r[0] for r in read.select(F.to_json("document")).collect()) == ['{"numbers":[1,2],"t":"ä"}', '{"numbers":[]}']


def test_views_of_photos(spark):
    photos = spark.createDataFrame(
        [("p", 1, "a", 1, None, {"k": "v"}, "s/p.jpg", "p.jpg", "u/p", "u/t", dt.datetime(2024, 1, 1)), ("q", 1, "a", 0, None, None, "s/q.jpg", "q.jpg", "u/q", None, None)],
        "photo_id string, job_id long, cluster_id string, order_index int, meta_timestamp timestamp_ntz, labels map<string,string>, storage_path string, original_filename string, url string, thumbnail_url string, deleted_at timestamp_ntz",
    )
    clusters = spark.createDataFrame([("a", 1, "n", 0), ("b", 1, "m", 1)], "cluster_id string, job_id long, name string, order_index int")
    got = {r.cluster_id: r.photos for r in views.edited_cluster_view(clusters, photos).collect()}
    assert got["b"] == [] and [(p.id, p.labels, p.url, p.thumbnail_path) for p in got["a"]] == [("q", None, "u/q", None), ("p", {"k": "v"}, "u/p", "u/t")]
    details = spark.createDataFrame([("p", "cam", 100), ("x", "no", 1)], "photo_id string, device string, iso int")
    assert rows(views.photos_with_details(photos, details).select("photo_id", "detail.device", "detail.iso")) == [("p", "cam", 100), ("q", None, None)]


def test_release(spark):
    with shared.scratch(spark) as kept:
        table = kept(spark.range(10), "ids")
    assert table.count() == 10
    shared.release(table)
    with pytest.raises(Exception):
        spark.read.schema("id long").parquet(*table.inputFiles()).count()
    shared.release(spark.range(3))
    outside = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    shared.release(outside)
    assert outside.count() == 5


def test_a_step_moves_its_rows_once(spark, monkeypatch, tmp_path):
    """Clusters are dealt out by job for the distinct and the numbering; replies are put together in their job's task; a sync and a move join no photos they needn't."""
    from shotledger.operators import mutations
    from shotledger.plans import catalog
    from shotledger.sources import tables

    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    logical = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(tables.clusters(spark, d)).count("Exchange") == 1
    assert "hashpartitioning(cluster_id" not in plan(catalog.before_replies(spark, d)[0])
    clusters, photos = tables.clusters(spark, d), tables.photos(spark, d)
    payload = clusters.selectExpr("job_id", "cluster_id", "name", "order_index", "array('nobody') as photo_ids")
    assert "LeftSemi" not in logical(mutations.sync(clusters, photos, payload)[0])
    seen, real = {}, mutations.materialise
    monkeypatch.setattr(mutations, "materialise", lambda df, name: seen.update({name: logical(df)}) or real(df, name))
    moves = photos.groupBy("job_id").agg({"photo_id": "min"}).selectExpr("`min(photo_id)` as photo_id", "cast(null as string) as cluster_id", "cast(null as int) as to_index")
    mutations.move_photos(clusters, photos, moves, photos["deleted_at"])
    assert seen["empty"].count("LeftAnti") == 1


@pytest.mark.parametrize("most", [0, shared.BROADCAST_BYTES])
def test_a_view_in_a_store_is_followed_where_its_rows_stand(spark, monkeypatch, most):
    """Some buckets at a time; nothing is moved by photo or by bucket, and nothing but the first tables before it is written, if the touched jobs may be broadcast."""
    from pyspark.sql import DataFrameWriter

    from shotledger.plans import upkeep
    from shotledger.sources import versions

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(versions, "AT_ONCE", 1)
    monkeypatch.setattr(incremental, "BROADCAST_BYTES", most)
    plans = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())) or real(self, path, *a, **k))
    got = upkeep.followed_details(spark, d)
    written = [p for path, p in plans if "/store/data/" in path]
    # Four tables, then view, photos and view again by four of the sixteen buckets at a time.
    assert len(written) == 4 + 3 * 4
    assert not [p for p in written if "hashpartitioning(photo_id" in p or "hashpartitioning(_bucket" in p]
    edited = written[8:12]
    assert ["REPARTITION_BY_NUM" in p for p in edited] == [most == 0] * 4
    live = tables.photos(spark, d).join(tables.jobs(spark, d), "job_id").where("deleted_at is null and not (order_index = 1 and user_id % 10 = 3)")
    want = {r.job_id: r["count"] for r in live.groupBy("job_id").count().collect()}
    assert {r.job_id: r.n_photos for r in got.collect() if r.n_photos} == want


def test_a_bucket_is_the_part_that_its_rows_are_dealt_into(spark):
    from shotledger.sources.versions import bucket

    for key in ("id", "cast(id as string)", "cast(null as int)"):
        rows = spark.range(500).selectExpr(f"{key} as k").repartition(7, "k")
        assert rows.where(bucket(F.col("k"), 7) != F.spark_partition_id()).count() == 0
