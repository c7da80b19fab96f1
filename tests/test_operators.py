"""Operators on hand-built rows: nulls, ties, edges, files, and metadata as cameras write it."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from shotledger import schemas
from shotledger.functions import exif
from shotledger.functions import scalars as X
from shotledger.operators import clustering, mutations, ordering, relations, states
from shotledger.operators.components import components
from shotledger.sources import files, photos, tables
from shotledger.streaming import callbacks


def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def values(spark, schema, data, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).coalesce(1).select(*columns).collect()]


def test_latest_run_order(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, 7, "PENDING", t, None), (2, 7, "EXPORTED", None, t), (3, 8, "FAILED", t, t), (4, 8, "PENDING", t, None)], "export_id long, job_id long, status string, created_at timestamp_ntz, finished_at timestamp_ntz")
    assert rows(relations.latest_per_job(runs).select("job_id", "export_id")) == [(7, 2), (8, 3)]
    jobs = spark.createDataFrame([(7,), (8,), (9,)], "job_id long")
    assert rows(relations.jobs_with_latest_run(jobs, runs).select("job_id", "export_status")) == [(7, "EXPORTED"), (8, "FAILED"), (9, "PENDING")]
    assert rows(relations.jobs_with_latest_run(jobs, runs, True).select("job_id", "export_id")) == [(7, 1), (8, 4), (9, None)]


@pytest.mark.parametrize("k, want", [(0, "cabd"), (2, "abcd"), (None, "abdc"), (-5, "cabd"), (99, "abdc")])
def test_insert_and_renumber(spark, k, want):
    photos = spark.createDataFrame([("a", "x", 0), ("b", "x", 5), ("c", "x", 1), ("d", "x", None), ("e", "y", 4)], "photo_id string, cluster_id string, order_index int")
    moves = spark.createDataFrame([("x", "c", k)], "cluster_id string, photo_id string, to_index int")
    got = {r.photo_id: r.order_index for r in ordering.insert_at(photos, moves).collect()}
    assert got.pop("e") == 4
    assert "".join(sorted(got, key=got.get)) == want and sorted(got.values()) == [0, 1, 2, 3]


def test_move_leaves_a_hole(spark):
    photos = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "x", 2), ("d", "y", 0)], "photo_id string, cluster_id string, order_index int")
    moves = spark.createDataFrame([("y", "b", 0)], "cluster_id string, photo_id string, to_index int")
    assert rows(ordering.insert_at(photos, moves)) == [("a", "x", 0), ("b", "y", 0), ("c", "x", 2), ("d", "y", 1)]


def test_gaps_and_append(spark):
    c = spark.createDataFrame([("a", 1, -1), ("b", 1, 0), ("c", 1, 1), ("d", 2, 0)], "cluster_id string, job_id long, order_index int")
    assert [r[2] for r in rows(ordering.open_gap(c, F.lit(1), "job_id"))] == [-1, 0, 2, 0]
    removed = spark.createDataFrame([(1, 0)], "job_id long, removed_index int")
    assert [r[2] for r in rows(ordering.close_gap(c, removed, "job_id"))] == [-1, 0, 0, 0]
    new = spark.createDataFrame([("n", 1, 1), ("m", 1, 0), ("o", None, 0)], "cluster_id string, job_id long, seq int")
    assert rows(ordering.append(c, new, "job_id", "cluster_id").select("cluster_id", "order_index")) == [("m", 3), ("n", 4), ("o", 0)]


def test_suffix_match(spark):
    photos = spark.createDataFrame([(1, "p1", "", "a/x.jpg"), (1, "p0", None, "a/x.jpg"), (1, "p2", "t/y.jpg", "zzz"), (2, "p3", "x.jpg", "q"), (1, "p4", None, None)], "job_id long, photo_id string, thumbnail_path string, storage_path string")
    items = spark.createDataFrame([(1, 1, "b/a/x.jpg"), (1, 2, "t/y.jpg"), (1, 3, "no"), (2, 4, "deep/ax.jpg"), (2, 5, None), (3, 6, "x.jpg")], "job_id long, item long, path string")
    assert rows(relations.suffix_match(items, photos).select("item", "photo_id")) == [(1, "p0"), (2, "p2"), (4, "p3")]


def test_nested_views_keep_parents(spark):
    clusters = spark.createDataFrame([("a", 1, "n", 0), ("b", 1, "n", 1)], "cluster_id string, job_id long, name string, order_index int")
    photos = spark.createDataFrame([("p", 1, "a", None, None, "s", "", None), ("q", 1, "a", 3, None, "s", "", None), ("r", 1, "b", 0, dt.datetime(2024, 1, 1), "s", "", None)], "photo_id string, job_id long, cluster_id string, order_index int, deleted_at timestamp_ntz, storage_path string, thumbnail_path string, meta_timestamp timestamp_ntz")
    got = {r.cluster_id: [p.photo_id for p in r.photos] for r in relations.clusters_with_photos(clusters, photos).collect()}
    assert got == {"a": ["q", "p"], "b": []}
    assert [r.cluster_id for r in relations.export_payload(clusters, photos).collect()] == ["a"]


def test_moving_the_last_photo_removes_its_cluster(spark):
    clusters = spark.createDataFrame([("a", 1, "n", 0), ("b", 1, "n", 1), ("r", 1, "reserve", -1)], "cluster_id string, job_id long, name string, order_index int")
    gone = dt.datetime(2024, 1, 1)
    photos = spark.createDataFrame([("p", 1, "a", 0, None), ("d", 1, "a", 1, gone), ("q", 1, "b", 0, None)], "photo_id string, job_id long, cluster_id string, order_index int, deleted_at timestamp_ntz")
    moves = spark.createDataFrame([("p", "b", None)], "photo_id string, cluster_id string, to_index int")
    c, p = mutations.move_photos(clusters, photos, moves, now())
    assert rows(c) == [("b", 1, "n", 0), ("r", 1, "reserve", -1)]
    assert {r.photo_id: (r.cluster_id, r.order_index) for r in p.collect()} == {"p": ("b", 1), "q": ("b", 0), "d": (None, 1)}


def test_apply_result(spark):
    jobs = spark.createDataFrame([(1, "", "title"), (2, "build", "t")], "job_id long, construction_type string, title string")
    clusters = spark.createDataFrame([("old", 1, "n", 0), ("other", 2, "n", 0)], "cluster_id string, job_id long, name string, order_index int")
    photo = "photo_id string, job_id long, cluster_id string, order_index int, thumbnail_path string, storage_path string, meta_lat double, meta_lon double, meta_timestamp timestamp_ntz"
    photos = spark.createDataFrame([("p", 1, "old", 4, "", "a.jpg", 1.0, 2.0, None), ("q", 1, "old", 5, "", "b.jpg", None, None, None), ("s", 1, "old", 6, "", "c.jpg", None, None, None), ("z", 2, "other", 0, "", "a.jpg", None, None, None)], photo)
    item = "struct<path: string, lat: double, lon: double, timestamp: double, device: string, focal_length: double, exposure_time: double, iso_speed_rating: int, flash: int, orientation: int, gps_img_direction: double>"
    more = lambda device=None, iso=None: (0.0, device, None, None, iso, None, None, None)
    result = spark.createDataFrame([(1, [(0, [("x/a.jpg", 0.0, 5.0, *more("lost", 1))]), (-1, [("x/b.jpg", None, None, *more())]), (2, []), (3, [("y/a.jpg", 9.0, 0.0, *more("cam", 7))])])], f"job_id long, clusters array<struct<id: int, photos: array<{item}>>>")
    details = spark.createDataFrame([("p", "old", 1), ("s", "old", 2)], "photo_id string, device string, iso int")
    c, p, d = clustering.apply_result(result, jobs, clusters, photos, details)
    assert rows(d.select("photo_id", "device", "iso")) == [("p", "cam", 7), ("q", None, None), ("s", "old", 2)]
    assert rows(c) == [("1-new-0", 1, "title", 0), ("1-new-2", 1, "title", 2), ("1-new-3", 1, "title", 3), ("1-reserve", 1, "reserve", -1), ("other", 2, "n", 0)]
    got = {r.photo_id: (r.cluster_id, r.order_index, r.meta_lat, r.meta_lon) for r in p.collect()}
    assert got == {"p": ("1-new-3", 0, 9.0, 2.0), "q": ("1-reserve", 0, None, None), "s": (None, 6, None, None), "z": ("other", 0, None, None)}


def test_results_meet_photos_as_by_joins(spark):
    """Paths with endings of several lengths, shared, empty and missing ones; several items for a photo and several photos for an item."""
    rnd = random.Random(4)
    ends = ["", *[f"{a}{b}.jpg" for a in ("", "x/", "a") for b in "abcdef"], None]
    photo = "photo_id string, job_id long, cluster_id string, order_index int, thumbnail_path string, storage_path string, meta_lat double, meta_lon double, meta_timestamp timestamp_ntz"
    photos = spark.createDataFrame([(f"p{k:03d}", rnd.choice([1, 2, 3, 4, None]), "old", k, rnd.choice(["", "", "", None, "a.jpg"]), rnd.choice(ends[k < 40 :]), None, None, None) for k in range(60)], photo)
    item = "struct<path: string, lat: double, lon: double, timestamp: double, device: string, focal_length: double, exposure_time: double, iso_speed_rating: int, flash: int, orientation: int, gps_img_direction: double>"
    sent = lambda k: [(rnd.choice(["", "z/y/x/", "z/y/xa", None])) for _ in range(k)]
    items = lambda k: [(None if a is None else a + rnd.choice(ends[:-1]), None, None, None, f"cam{rnd.randrange(9)}", None, None, None, None, None, None) for a in sent(k)]
    result = spark.createDataFrame([(j, [(n - 1, items(9) if n != 2 else None) for n in range(5)]) for j in (1, 2, 9)] + [(3, []), (None, [(1, items(3))])], f"job_id long, clusters array<struct<id: int, photos: array<{item}>>>")
    jobs = spark.createDataFrame([(1, "", "t")], "job_id long, construction_type string, title string")
    clusters = spark.createDataFrame([], "cluster_id string, job_id long, name string, order_index int")
    details = spark.createDataFrame([(f"p{k:03d}", "old") for k in range(0, 60, 3)], "photo_id string, device string")
    _, p, d = clustering.apply_result(result, jobs, clusters, photos, details)
    flat = result.select("job_id", F.posexplode("clusters").alias("entry", "c")).select("job_id", "entry", "c.id", F.posexplode("c.photos").alias("at", "i")).select("job_id", "id", F.struct("entry", "at", "i").alias("item"), F.col("i.path").alias("path"))
    hits = relations.last_written(relations.suffix_match(flat, photos).select("photo_id", "item"), "photo_id", "item")
    want = {r.photo_id: r.item for r in hits.collect()}
    got = {r.photo_id: r for r in p.collect()}
    assert len(want) > 10 and len(got) == p.count() == 60
    for r in photos.collect():
        hit = want.get(r.photo_id)
        names = {"old"} if r.job_id not in (1, 2, 3) else {None} if hit is None else {f"{r.job_id}-reserve" if hit.entry == 0 else f"{r.job_id}-new-{hit.entry}"}
        assert (got[r.photo_id].cluster_id, got[r.photo_id].order_index) == (names.pop(), r.order_index if hit is None else hit.at)
    old = {r.photo_id: r.device for r in details.collect()}
    assert rows(d) == sorted((old | {k: h.i.device for k, h in want.items()}).items())


def test_a_result_is_applied_in_its_jobs_task(spark):
    """Photos go to their job's task once and items are there already: nothing is moved by photo or by ending. Only details, which name no job, are moved by photo, and new ones are made once."""
    from shotledger.plans import catalog

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    photos = plan(catalog.apply_cluster_result(spark, "/root/testdata/sf0.001"))
    by = re.findall(r"hashpartitioning\(([^)]*), \d+\)", photos)
    assert by and {x.split("#")[0] for x in by} <= {"job_id", "request_id", "cluster_job_id"} and not [x for x in by if "," in x]
    assert photos.count("lineitem.parquet") == 2
    details = plan(catalog.apply_result_details(spark, "/root/testdata/sf0.001"))
    assert details.count("lineitem.parquet") == 3 and "_ending#" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", details))


def test_syncs_within_jobs_say_what_syncs_say(spark):
    """Lists that share photos, unknown ids, null names, places, jobs and photos, clusters under another job; as lists name no photo of another job."""
    rnd = random.Random(7)
    clusters = spark.createDataFrame([(f"{j}-{c}", j, f"n{c}", c) for j in range(1, 9) for c in range(4)] + [("lone", None, "n", 0)], "cluster_id string, job_id long, name string, order_index int")
    own = [(f"p{k:03d}", rnd.randrange(1, 10), k) for k in range(90)]
    photos = spark.createDataFrame([(p, j, rnd.choice([f"{j}-0", f"{j}-1", None]), k) for p, j, k in own] + [(None, 1, "1-0", 5), ("x", None, "lone", 2)], "photo_id string, job_id long, cluster_id string, order_index int")
    lists = [(j if rnd.random() < 0.8 else -j, f"{j}-{c}", rnd.choice(["", None, "new"]), rnd.choice([None, 3, 5, 9]), [rnd.choice([p for p, o, _ in own if o == j] + ["nobody", None]) for _ in range(8)]) for j in range(1, 10) for c in range(5)]
    payload = spark.createDataFrame(lists + [(None, "lone", "new", 1, ["x"]), (1, None, "new", 1, ["x"]), (2, "2-9", "new", 1, None)], "job_id long, cluster_id string, name string, order_index int, photo_ids array<string>")
    want, got = (mutations.sync(clusters, photos, payload, elsewhere=e) for e in (True, False))
    for a, b in zip(want, got):
        assert a.columns == b.columns and rows(a) == rows(b) and rows(b)
    assert rows(got[1]) != rows(photos) and rows(got[0]) != rows(clusters)


def test_a_sync_within_jobs_moves_photos_once(spark):
    from shotledger.plans import catalog

    found = catalog.sync_apply(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert {x.split("#")[0] for x in re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)} == {"job_id"} and "Join" not in plan
    assert plan.count("ReusedExchange") >= 4


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and got[100] == got[101] == got[102] != got[0] and 200 not in got


def test_density_clusters(spark):
    step = 10 / 111_195
    data = [(1, k, 60 + k * step, 179.9999, 0.0) for k in range(5)] + [(1, 10, 60.0, -179.0, 0.0), (1, 11, None, 1.0, 0.0), (1, 12, 60 + 2 * step, 179.9999, 500.0), (2, 20, 0.0, 0.0, 0.0), (2, 21, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(data, "job_id long, point long, lat double, lon double, alt double")
    assert {r.point: r.label for r in clustering.density_clusters(points, 3, 12.0, 20.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 10: -1, 11: -1, 12: -1, 20: -1, 21: -1}
    assert clustering.density_clusters(points.limit(0)).count() == 0


def test_exif(spark):
    r = "struct<num: long, den: long>"
    schema = f"dms array<{r}>, ref string, alt {r}, below int, way {r}, wref string"
    data = [([(37, 1), (30, 1), (0, 1)], "n", (10, 2), 1, (5, 1), "M"), ([(37, 1), (30, 1), (0, 0)], "N", (1, 0), 0, (350, 1), "T"), ([(37, 1), (30, 1), (0, 1)], None, None, None, None, None)]
    c = F.col
    got = values(spark, schema, data, exif.degrees(c("dms"), c("ref")), exif.altitude(c("alt"), c("below")), exif.direction(c("way"), c("wref")))
    assert got == [(37.5, -5.0, 356.5), (None, None, 350.0), (-37.5, None, None)]
    times = [("2024:01:02 03:04:05", "5", "+00:00"), ("2024:1:2  3:4:5", None, None), ("0000:00:00 00:00:00", None, None), ("bad", "1", "x"), ("2024:01:02 03:04:05", "12345678", "-01:30")]
    got = [x for (x,) in values(spark, "t string, s string, o string", times, exif.epoch_seconds(c("t"), c("s"), c("o")))]
    base = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc).timestamp()
    assert got == [base + 0.5, base - 9 * 3600, None, None, base + 5400 + 0.123456]


def test_texts_and_paths(spark):
    c = F.col
    data = [("u/job/original/a.b.jpg", ""), ("x.png", None), ("d/.hidden", "d/.hidden"), ("a/b", "t/c.jpg")]
    got = values(spark, "p string, t string", data, X.basename(c("p")), X.stem(c("p")), X.extension(c("p")), X.thumbnail_path(c("p"), c("t")))
    assert got == [("a.b.jpg", "a.b", ".jpg", "u/job/thumbnail/a.b_thumb.jpg"), ("x.png", "x", ".png", "thumbnail/x_thumb.jpg"), (".hidden", ".hidden", "", "thumbnail/.hidden_thumb.jpg"), ("b", "b", "", "t/c.jpg")]
    stamps = [(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 6000),), (None,)]
    assert values(spark, "t timestamp_ntz", stamps, X.iso_text(c("t"))) == [("2024-01-02T03:04:05",), ("2024-01-02T03:04:05.006000",), ("",)]
    assert values(spark, "s double", [(0.0,), (None,), (1.5,)], X.from_epoch(c("s"), "Asia/Seoul")) == [(None,), (None,), (dt.datetime(1970, 1, 1, 9, 0, 1, 500000),)]
    assert values(spark, "a string", [("",), (None,), ("x",)], X.first_filled(c("a"), F.lit("d"))) == [("d",), ("d",), ("x",)]


def test_register_and_labels(spark):
    users = spark.createDataFrame([("u1", "taken_name", "c")], "user_id string, username string, company_name string")
    requests = spark.createDataFrame([(1, "taken_name", "secret", "co"), (2, "newname", "secret", "co"), (3, "newname", "secret", "co"), (4, "short", "secret", "co"), (5, "longenough", "12345", "co"), (6, None, "secret", "co")], "request int, username string, password string, company_name string")
    assert rows(mutations.register(users, requests)) == [(2, "newname", "co")]


def test_states_and_correlation(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, 1, t, "FAILED", "e"), (1, 2, t, "PENDING", "x"), (2, 3, t, "FAILED", "m")], "job_id long, event_id long, ts timestamp_ntz, status string, error string")
    assert rows(states.fold(events).select("job_id", "status", "error", "n_events")) == [(1, "PENDING", None, 2), (2, "FAILED", "m", 1)]


def test_files(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / name).write_bytes(b"0123456789")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.jpeg").write_bytes(b"x")
    listed = files.list_photos(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed.collect()) == ["a.JPG", "b.png"]
    assert {bytes(r.content) for r in files.contents(spark, str(tmp_path / "a.JPG"), 3).collect()} == {b"0123"}
    left = files.outside(listed.select(F.regexp_replace("path", ".*/", "p/x/").alias("path")).union(spark.createDataFrame([("p/xy",)], "path string")), "p/x")
    assert [r.path for r in left.collect()] == ["p/xy"]
    (tmp_path / "c.txt").write_text("two\nlines")
    assert [r.value for r in files.read_text(spark, str(tmp_path / "c.txt")).collect()] == ["two\nlines"]
    (tmp_path / "bad.json").write_text("{bad")
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "bad.json"), "a int").collect()
    assert values(spark, "p string", [("gs://b/x",), ("file:///x",), ("/x",)], files.scheme_of(F.col("p"))) == [("gcs",), ("local",), ("local",)]


def test_schemas(spark):
    old = spark.createDataFrame([("j1", "u", "t", "gone")], "job_id string, user_id string, title string, contractor string")
    new = schemas.conform(schemas.evolve(old, add={"company_name": "string"}, drop=("contractor",), narrow={"title": 5}), "jobs")
    assert new.columns[:3] == ["job_id", "user_id", "title"] and new.first().company_name is None
    with pytest.raises(Exception, match="longer"):
        schemas.evolve(old.withColumn("title", F.lit("too long")), narrow={"title": 5}).collect()
    assert set(schemas.TABLES) == {"users", "jobs", "clusters", "photos", "photo_details", "cluster_jobs", "export_jobs"}
    for spec in schemas.PAYLOADS.values():
        assert spark.createDataFrame([("{}",)], "b string").select(F.from_json("b", spec)).count() == 1


def test_unique_stops_on_a_second_row(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "username string, n int")
    with pytest.raises(Exception, match="more than one row"):
        tables.unique(twice, "username").collect()
    assert rows(tables.unique(twice.where("n <> 2"), "username")) == [("a", 1), ("b", 3)]


def tiff(order="<"):
    """A TIFF block with the tags the decoder reads, a GPS block and an embedded thumbnail."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)

    def block(at, tags, following=0):
        data_at = at + 2 + 12 * len(tags) + 4
        head, data = struct.pack(order + "H", len(tags)), b""
        for tag, kind, count, raw in tags:
            if len(raw) > 4:
                head += struct.pack(order + "HHII", tag, kind, count, data_at + len(data))
                data += raw
            else:
                head += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        return head + struct.pack(order + "I", following) + data

    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    short = lambda n: (3, 1, struct.pack(order + "H", n))
    long = lambda n: (4, 1, struct.pack(order + "I", n))
    ratio = lambda *xs: (5, len(xs) // 2, struct.pack(f"{order}{len(xs)}I", *xs))
    main = [(0x010F, *text("Maker")), (0x0110, *text("Cam")), (0x0112, *short(6)), (0x8769, *long(200)), (0x8825, *long(400))]
    sub = [(0x829A, *ratio(1, 100)), (0x8827, *short(200)), (0x9003, *text("2024:01:02 03:04:05")), (0x9011, *text("+00:00")), (0x920A, *ratio(50, 10)), (0x9291, *text("25"))]
    gps = [(1, *text("N")), (2, *ratio(37, 1, 30, 1, 0, 1)), (3, *text("W")), (4, *ratio(127, 1, 0, 1, 0, 1)), (5, 1, 1, b"\1"), (6, *ratio(15, 2)), (16, *text("M")), (17, *ratio(5, 1))]
    thumb = [(0x0201, *long(700)), (0x0202, *long(4))]
    for at, raw in ((8, block(8, main, 600)), (200, block(200, sub)), (400, block(400, gps)), (600, block(600, thumb)), (700, b"\xff\xd8TH")):
        out = out.ljust(at, b"\0") + raw
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_of_files(spark, tmp_path, order):
    block = b"Exif\0\0" + tiff(order)
    jpeg = b"\xff\xd8" + b"\xff\xe0\0\x04ab" + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda\0\2pixels"
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "good.jpg").write_bytes(jpeg)
    (folder / "bad.jpg").write_bytes(jpeg[:60])
    (folder / "none.jpg").write_bytes(b"none")
    got = {r.original_name: r for r in photos.metadata(files.contents(spark, str(folder))).collect()}
    good = got["good.jpg"]
    assert (good.lat, good.lon, good.alt, good.gps_img_direction, good.device) == (37.5, -127.0, -7.5, 356.5, "Maker Cam")
    assert (good.focal_length, good.exposure_time, good.iso, good.orientation, bytes(good.thumbnail)) == (5.0, 0.01, 200, 6, b"\xff\xd8TH")
    assert good.timestamp == dt.datetime(2024, 1, 2, 3, 4, 5, 250000, tzinfo=dt.timezone.utc).timestamp()
    assert got["bad.jpg"].lat is got["none.jpg"].timestamp is None
    infos = spark.createDataFrame([("one", "good.jpg", None), ("two", "none.jpg", "t.jpg"), ("three", "missing.jpg", None)], "filename string, storage_path string, thumbnail_path string")
    rows_ = {r.original_filename: r for r in photos.register_uploads(spark, infos, str(folder), 20).collect()}
    assert set(rows_) == {"one", "two", "three"} and rows_["two"].thumbnail_path is rows_["three"].thumbnail_path is rows_["three"].meta_lat is None
    assert rows_["one"].thumbnail_path == "thumbnail/good_thumb.jpg"
    assert rows_["one"].meta_timestamp == dt.datetime(2024, 1, 2, 12, 4, 5, 250000) and rows_["one"].meta_lat == 37.5


def test_reply_stream(spark, tmp_path):
    drop, out = tmp_path / "drop", tmp_path / "out"
    drop.mkdir()
    replies = [{"request_id": "e1", "status": "completed", "result": {"pdf_url": "p"}}, {"request_id": "e2", "status": "failed", "error": "why"}, {"request_id": "e9", "status": "completed"}, {"request_id": "e3", "status": "started"}]
    for k, r in enumerate(replies):
        (drop / f"{k}.json").write_text(json.dumps(r, indent=2))
    (drop / "bad.json").write_text("{no")
    requests = spark.createDataFrame([("e1", 1), ("e2", 2), ("e3", 3)], "export_id string, job_id long")
    events = callbacks.as_events(callbacks.reply_stream(spark, str(drop)), requests)
    events.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(out)).awaitTermination()
    assert rows(spark.read.parquet(str(out)).select("job_id", "status", "error", "pdf_path")) == [(1, "EXPORTED", None, "p"), (2, "FAILED", "why", None)]


def test_neighbours_meet_across_the_meridian_and_the_poles(spark):
    spots = [(10.0, 179.99999), (10.0, -179.99999), (10.0, 180.0), (10.0, 179.0), (-45.00001, -179.99998), (-44.99999, 179.99998), (89.99999, 0.0), (89.99999, 180.0), (-89.995, 50.0), (-89.995, 51.0), (89.6, 10.0), (89.6, 10.0245), (88.999999, 30.0), (89.000001, 30.006), (0.0, 0.0), (0.0001, -0.0001)]
    points = spark.createDataFrame([(1, k, lat, lon) for k, (lat, lon) in enumerate(spots)], "job_id long, point long, lat double, lon double")

    def metres(p, q):
        a, b = math.radians(p[0]), math.radians(q[0])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * clustering.EARTH_M * math.asin(math.sqrt(h))

    for far in (20.0, 1000.0):
        want = sorted((i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if i != j and metres(p, q) <= far)
        assert sorted((r.a, r.b) for r in clustering.neighbours(points, far).collect()) == want and (0, 1) in want and (6, 7) in want
    labels = {r.point: r.label for r in clustering.density_clusters(points, 3, 20.0).collect()}
    assert labels[0] == labels[1] == labels[2] >= 0


@pytest.mark.parametrize("alt", [None, 5.0])
def test_density_clusters_by_cells_are_those_by_pairs(spark, alt):
    pick = random.Random(3)
    data = []
    for job in range(3):
        for _ in range(14):
            lat, lon, height = pick.choice([0.0, 60.0, -89.9995, 45.0]) + pick.random() * 0.002, pick.choice([179.9995, 10.0]) + pick.random() * 0.001, pick.random() * 20
            for _ in range(pick.randrange(1, 25)):
                east = lon + pick.gauss(0, 0.00006)
                data.append((job, len(data), lat + pick.gauss(0, 0.00004), east - 360 if east > 180 else east, height + pick.gauss(0, 2)))
    data += [(9, 5000, None, 1.0, 1.0), (9, 5001, 1.0, 1.0, None)]
    points = spark.createDataFrame(data, "job_id long, point long, lat double, lon double, alt double")
    by_pairs = clustering._by_pairs(points, 4, 12.0, alt, None)
    assert rows(clustering.density_clusters(points, 4, 12.0, alt)) == rows(by_pairs) and by_pairs.select("label").distinct().count() > 3


def test_a_crowd_in_one_place_is_not_paired(spark, monkeypatch):
    """5,000 points within a metre, a chain of crowded cells, and a lone point at its end."""
    met = []
    real = clustering._meeting
    monkeypatch.setattr(clustering, "_meeting", lambda *a, **k: met.append(real(*a, **k)) or met[-1])
    step = 6 / 111_195
    data = [(1, k, 10.0 + (k % 7) * 1e-7, 20.0) for k in range(5000)] + [(1, 6000 + k, 10.0 + (k // 20) * step, 20.0) for k in range(200)] + [(1, 7000, 10.0 + 9 * step + 10 / 111_195, 20.0)]
    points = spark.createDataFrame(data, "job_id long, point long, lat double, lon double")
    got = clustering.density_clusters(points, 3, 12.0)
    assert {r.label for r in got.collect()} == {0}
    assert len(met) == 4


def test_near_points_are_joined_without_a_broadcast(spark):
    rows = spark.range(200).selectExpr("id % 3 as job_id", "id as point", "37.5 + id * 0.0001 as lat", "127.0 as lon", "1.0 as alt")
    for found in (clustering.neighbours(rows, 150.0), clustering.neighbours(rows, 150.0, 20.0)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_points_at_the_edges_of_bands_meet(spark):
    at = [-1.00001, -0.99999, -0.00001, 0.00001, 0.99999, 1.00001, 59.99999, 60.00001]
    points = spark.createDataFrame([(1, k, lat, 10.0) for k, lat in enumerate(at)], "job_id long, point long, lat double, lon double")
    found = clustering.neighbours(points, 20.0).collect()
    assert sorted((r.a, r.b) for r in found) == [(0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4), (6, 7), (7, 6)] and all(2.2 < r.metres < 2.3 for r in found)


@pytest.mark.parametrize("alt, block", [(None, 2048), (5.0, 4)])
def test_density_clusters_by_blocks_are_those_by_pairs(spark, alt, block):
    pick = random.Random(5)
    data = []
    for job in range(3):
        for _ in range(6):
            lat, lon, looks = pick.choice([0.0, 60.0, 45.0]) + pick.random() * 0.0005, pick.choice([179.9998, 10.0]), [[pick.gauss(0, 1) for _ in range(5)] for _ in range(3)]
            for _ in range(pick.randrange(1, 20)):
                east = lon + pick.gauss(0, 0.0001)
                data.append((job, len(data), lat + pick.gauss(0, 0.0001), east - 360 if east > 180 else east, pick.gauss(0, 3), [x + pick.gauss(0, 0.5) for x in pick.choice(looks)]))
    odd = [[0.0] * 5, [None, 1.0, 1.0, 0.0, 0.0], [1.0, 1.0], [], None, [float("nan")] * 5, [1.0, 0.0, 0.0, 0.0, 0.0], [0.8, 0.6, 0.0, 0.0, 0.0]]
    data += [(8, 9000 + k, 10.0, 10.0, 1.0, f) for k, f in enumerate(odd)] + [(9, 9100, None, 1.0, 1.0, [1.0]), (9, 9101, 1.0, 1.0, None, [1.0])]
    points = spark.createDataFrame(data, "job_id long, point long, lat double, lon double, alt double, features array<double>")
    by_pairs = clustering._by_pairs(points, 3, 15.0, alt, 0.8)
    got = clustering._by_blocks(points, 3, 15.0, alt, 0.8, block)
    assert rows(got) == rows(by_pairs) and by_pairs.select("label").distinct().count() > 3
    assert clustering.density_clusters(points.limit(0), 3, 15.0, alt, 0.8).count() == 0


def test_nested_moves_rows_and_not_lists(spark):
    """Rows go to their parent's task as they are; lists are made there."""
    rows = spark.createDataFrame([("a", "x", 2, "l"), ("b", "x", None, "m"), ("c", "x", 1, "n"), ("d", None, 0, "o")], "photo_id string, cluster_id string, order_index int, note string")
    found = relations.nested(rows, "cluster_id", "photos", "photo_id", "note", key="photo_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_collect_list" in plan.split("Exchange")[0]
    assert {r.cluster_id: [tuple(p) for p in r.photos] for r in found.collect()} == {"x": [("c", "n"), ("a", "l"), ("b", "m")], None: [("d", "o")]}
