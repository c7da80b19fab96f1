"""Logs of edits against the same edits one by one on plain rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from shotledger.operators import mutations, ordering, relations, replay
from tests.test_operators import now, rows

AT = dt.datetime(2030, 1, 1)
CLUSTERS = "cluster_id string, job_id long, name string, order_index int, created_at timestamp_ntz"
PHOTOS = "photo_id string, job_id long, cluster_id string, order_index int, deleted_at timestamp_ntz, note string"
EDITS = "edit_id long, job_id long, kind string, photo_id string, cluster_id string, to_index int, photo_ids array<string>, name string, at timestamp_ntz"


class Plain:
    """One job as rows that every edit searches and renumbers anew."""

    def __init__(self, job, clusters, photos, title):
        self.job, self.title = job, title
        self.c = {c: [n, i] for c, j, n, i in clusters if j == job}
        self.p = {p: [c, i, d] for p, j, c, i, d in photos if j == job}

    def line(self, cluster, but=None):
        own = [p for p, (c, _, d) in self.p.items() if c == cluster and d is None and p != but]
        return sorted(own, key=lambda p: (self.p[p][1] is None, self.p[p][1] or 0, p))

    def drop(self, cluster):
        for x in self.p.values():
            if x[0] == cluster:
                x[0], x[2] = None, AT
        gone = self.c.pop(cluster)[1]
        for x in self.c.values():
            x[1] -= x[1] > gone

    def edit(self, kind, p, c, k, ids, name):
        if kind == "move_photo" and p in self.p:
            if c is None:
                c = min((x for x, (n, _) in self.c.items() if n == "reserve"), default=None)
                if c is None:
                    c = f"{self.job}-reserve"
                    self.c[c] = ["reserve", -1]
            if c not in self.c:
                return
            source = self.p[p][0]
            if source == c and k is None:
                return
            line = self.line(c, p)
            line.insert(len(line) if k is None else max(0, min(k, len(line))), p)
            for i, x in enumerate(line):
                self.p[x][1] = i
            self.p[p][0] = c
            if source != c and source in self.c and self.c[source][0] != "reserve" and not self.line(source):
                self.drop(source)
        elif kind == "delete_photo" and p in self.p:
            self.p[p][2] = AT
        elif kind == "create_cluster" and self.title is not None and c not in self.c:
            k = len(self.c) if k is None else max(0, min(k, len(self.c)))
            for x in self.c.values():
                x[1] += x[1] >= k
            self.c[c] = [self.title, k]
            self.take(c, ids, 0)
        elif kind == "add_photos" and c in self.c:
            self.take(c, ids, sum(x[0] == c for x in self.p.values()))
        elif kind == "update_cluster" and c in self.c:
            self.c[c][0] = name or self.c[c][0]
            if k and k > 0:
                self.c[c][1] = k
        elif kind == "delete_cluster" and c in self.c:
            self.drop(c)

    def take(self, c, ids, first):
        found = sorted({x for x in ids or () if x in self.p}, key=lambda x: (self.p[x][1] is None, self.p[x][1] or 0, x))
        for i, x in enumerate(found):
            self.p[x][0], self.p[x][1] = c, first + i


def made(seed, jobs, n_photos, n_edits):
    pick = random.Random(seed)
    clusters, photos, edits = [], [], []
    for j in jobs:
        ids = [f"{j}c{k}" for k in range(6)]
        clusters += [(c, j, "reserve" if k == 0 and j % 2 else f"n{k}", k - 1) for k, c in enumerate(ids)]
        photos += [(f"{j}p{k}", j, pick.choice([*ids, None]), pick.choice([None, *range(12)]), pick.choice([None, None, None, AT])) for k in range(n_photos)]
        for e in range(n_edits):
            kind = pick.choices(replay.KINDS, [12, 2, 2, 1, 1, 0.3 if e % 3 else 0])[0]
            p, c = f"{j}p{pick.randrange(n_photos + 1)}", pick.choice([*ids, *ids, None, "nowhere", f"{j}new{pick.randrange(9)}"])
            if kind == "create_cluster":
                c = f"{j}new{pick.randrange(9)}"
            some = pick.choice([None, [f"{j}p{pick.randrange(n_photos + 1)}" for _ in range(pick.randrange(9))]])
            edits.append((e, j, kind, p, c, pick.choice([None, *range(-1, 15)]), some, pick.choice([None, "", "named"]), AT))
    pick.shuffle(edits)
    return clusters, photos, edits


def run(spark, clusters, photos, jobs, edits):
    c = spark.createDataFrame([(*x, None) for x in clusters], CLUSTERS)
    p = spark.createDataFrame([(*x, "kept") for x in photos], PHOTOS)
    j = spark.createDataFrame(jobs, "job_id long, construction_type string, title string")
    return replay.replay(c, p, j, spark.createDataFrame(edits, EDITS))


@pytest.mark.parametrize("n_photos, n_edits, block", [(12, 120, 512), (400, 1500, 4), (0, 5, 512)])
def test_against_one_by_one(spark, monkeypatch, n_photos, n_edits, block):
    monkeypatch.setattr(replay, "BLOCK", block)
    clusters, photos, edits = made(n_photos, [1, 2, 3, 4], n_photos, n_edits)
    edits = [e for e in edits if e[1] != 4]  # a job without edits
    jobs = [(1, "built", "t"), (2, "", "t"), (4, "x", "y")]
    want = [Plain(j, clusters, photos, t) for j, t in ((1, "built"), (2, "t"), (3, None), (4, "x"))]
    for e in sorted(edits):
        want[e[1] - 1].edit(*e[2:8])
    c, p, refused = run(spark, clusters, photos, jobs, edits)
    assert rows(c.select("cluster_id", "job_id", "name", "order_index")) == sorted(((k, w.job, *x) for w in want for k, x in w.c.items()), key=repr)
    assert rows(p.select("photo_id", "job_id", "cluster_id", "order_index", "deleted_at")) == sorted(((k, w.job, *x) for w in want for k, x in w.p.items()), key=repr)
    assert {r["note"] for r in p.collect()} <= {"kept"} and {r["job_id"] for r in refused.collect()} <= {1, 2, 3}


def test_no_edits_and_unknown_kinds(spark):
    clusters, photos, _ = made(1, [1], 5, 0)
    c, p, refused = run(spark, clusters, photos, [(1, "x", "y")], [])
    assert c.count() == len(clusters) and p.count() == 5 and refused.count() == 0
    _, _, refused = run(spark, clusters, photos, [(1, "x", "y")], [(1, 1, "paint", None, "1c1", None, None, None, AT), (2, 9, "move_photo", "1p0", "1c1", None, None, None, AT)])
    assert rows(refused) == [(1, 1, "no such kind of edit"), (9, 2, "no such photo")]


def test_places_far_apart_are_found_fast():
    line = replay.Places(f"p{k}" for k in range(50_000))
    for k in range(20_000):
        line.close()
        line.insert(k * 7 % line.length, f"q{k}")
        if k % 3 == 0:
            line.open(f"p{k}")
    line.close()
    assert line.length == len(list(line)) == 50_000 + 20_000 - 6667 and all(line.rank(x) == k for k, x in enumerate(line) if k % 997 == 0)


def test_deleted_photos_hold_no_place(spark):
    schema = "photo_id string, job_id long, cluster_id string, order_index int, deleted_at timestamp_ntz"
    clusters = spark.createDataFrame([("x", 1, "n", 0), ("y", 1, "n", 1)], "cluster_id string, job_id long, name string, order_index int")
    photos = spark.createDataFrame([("d", 1, "x", 0, AT), ("a", 1, "x", 1, None), ("b", 1, "x", 2, None), ("m", 1, "y", 0, None), ("o", 1, "y", 1, None)], schema)
    moves = spark.createDataFrame([("m", "x", 1)], "photo_id string, cluster_id string, to_index int")
    _, p = mutations.move_photos(clusters, photos, moves, now())
    assert [r[:2] for r in sorted((r.order_index, r.photo_id, r.cluster_id) for r in p.where("cluster_id = 'x' and deleted_at is null").collect())] == [(0, "a"), (1, "m"), (2, "b")]
    assert p.where("photo_id = 'd'").first().order_index == 0
    _, p = mutations.move_photos(clusters, photos, spark.createDataFrame([("a", "x", None)], moves.schema), now())
    assert {r.photo_id: r.order_index for r in p.collect()} == {"d": 0, "a": 1, "b": 2, "m": 0, "o": 1}
    p = ordering.insert_at(photos, spark.createDataFrame([("x", "d", 1)], "cluster_id string, photo_id string, to_index int"), counted=photos["deleted_at"].isNull())
    assert {r.photo_id: r.order_index for r in p.where("cluster_id = 'x'").collect()} == {"a": 0, "d": 1, "b": 2}


def test_unknown_ids_hold_their_place_and_empty_names_count(spark):
    clusters = spark.createDataFrame([("x", 1, "n", 0), ("y", 1, "m", 1)], "cluster_id string, job_id long, name string, order_index int")
    photos = spark.createDataFrame([("a", "x", 0), ("b", "y", 0)], "photo_id string, cluster_id string, order_index int")
    payload = spark.createDataFrame([(1, "x", "", 5, ["zz", "b", "a"]), (1, "y", None, None, None)], "job_id long, cluster_id string, name string, order_index int, photo_ids array<string>")
    c, p = mutations.sync(clusters, photos, payload)
    assert rows(c) == [("x", 1, "", 5), ("y", 1, "m", 1)] and rows(p) == [("a", "x", 2), ("b", "x", 1)]


def test_folder_of_the_first_thumbnail(spark):
    photos = spark.createDataFrame([(1, "p1", 0, "", "a/o/1.jpg"), (1, "p2", 1, "a/t/2.jpg", "a/o/2.jpg"), (2, "p3", None, None, "b/o/3.jpg"), (3, "p4", 0, "", None)], "job_id long, photo_id string, order_index int, thumbnail_path string, storage_path string")
    assert rows(relations.bucket_folder(photos)) == [(1, "a/t", 2), (2, "b/o", 1), (3, None, 1)]


def test_jobs_of_a_task_are_taken_one_after_the_other():
    """Jobs cut by the ends of batches, and more results than a batch takes, without a group for each job."""
    import pyarrow as pa

    kinds = pa.schema([("job_id", pa.int64()), ("is", pa.string()), ("id", pa.string()), ("parent", pa.string()), ("name", pa.string()), ("place", pa.int32()), ("dead", pa.bool_()), ("edit_id", pa.int64()), ("kind", pa.string()), ("photo_ids", pa.list_(pa.string())), ("at", pa.timestamp("us"))])
    rows = []
    for job in range(9000):
        rows.append((job, "cluster", f"c{job}", None, "n", 0, None, None, None, None, None))
        rows.append((job, "photo", f"p{job}", f"c{job}", None, 3, False, None, None, None, None))
        rows.append((job, "edit", f"p{job}", None, None, None, None, 1, "delete_photo", None, 1_000_000 + job))
    rows = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k.type) if k.name == "at" else pa.array(c, k.type) for k, c in zip(kinds, zip(*rows[i : i + 1000]))], schema=kinds) for i in range(0, len(rows), 1000)]
    found = list(replay._replayed_jobs(iter(rows)))
    assert len(found) == 2 and [b.column("id").to_pylist() for b in found] == [[f"p{j}" for j in range(8192)], [f"p{j}" for j in range(8192, 9000)]]
    assert found[1].column("at").cast(pa.int64()).to_pylist()[-1] == 1_000_000 + 8999 and set(found[0].column("parent").to_pylist()[:2]) == {"c0", "c1"}
    assert list(replay._replayed_jobs(iter([]))) == []


def test_columns_are_turned_into_lists_at_once():
    import pyarrow as pa

    columns = [pa.array([1, None, 3]), pa.array([True, None, False]), pa.array(["a", None, ""]), pa.array([["a", None], None, []], pa.list_(pa.string())), pa.array([None, 5, 6], pa.int32()), pa.array([2, 3, 4], pa.int64())]
    for c in columns:
        for part in (c, c.slice(1), c.slice(0, 0), c.slice(1, 1)):
            assert replay._values(part) == part.to_pylist()


def test_lists_that_no_edit_takes_are_not_moved(spark, monkeypatch):
    """Only two kinds of edits take a list of photos; the lists of others aren't sent to Python, and the edits do the same."""
    seen = []
    monkeypatch.setattr(replay, "materialise", lambda df, name: seen.append(df) or df)
    clusters, photos, _ = made(3, [1], 5, 0)
    edits = [(k, 1, kind, "1p0", "1c1", None, ["1p2", "1p3"], None, AT) for k, kind in enumerate(("move_photo", "add_photos", "delete_photo", "update_cluster"))]
    _, p, refused = run(spark, clusters, photos, [(1, "x", "y")], edits)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "add_photos" in plan and "photo_ids" in plan
    assert {r.photo_id for r in p.where("cluster_id = '1c1'").collect()} >= {"1p0", "1p2", "1p3"} and refused.count() == 0
