"""Streams against tables: the state machine, requests and replies, replies into versions."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from shotledger.operators import clustering, states
from shotledger.plans import catalog, streams
from shotledger.sources import shared, versions
from shotledger.streaming import apply, callbacks, correlation, machine
from tests.test_operators import rows

EVENTS = "job_id long, event_id long, ts timestamp, status string"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


class Folder:
    """A folder of events that files are added to, and the log of the stream over it."""

    def __init__(self, spark, path, steps, delay="10 minutes"):
        self.spark, self.path, self.steps, self.delay, self.n = spark, path, steps, delay, 0
        (path / "in").mkdir(parents=True)

    def add(self, events):
        self.n += 1
        self.spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(f"{self.path}/tmp{self.n}")
        (part,) = (self.path / f"tmp{self.n}").glob("part-*.parquet")
        part.rename(self.path / "in" / f"{self.n:04d}.parquet")

    def run(self):
        events = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        machine.write_log(machine.outcomes(events, self.steps, delay=self.delay), f"{self.path}/log", f"{self.path}/checkpoint")
        return self.spark.read.schema(f"{EVENTS.replace('status', 'wanted')}, status string, taken boolean").parquet(f"{self.path}/log")

    def finish(self):
        self.add([(None, None, at(10_000_000), None)])
        return self.run()


@pytest.mark.parametrize("steps", [states.JOB_STEPS, states.EXPORT_STEPS])
def test_machine_stream_says_what_the_table_says(spark, tmp_path, steps):
    pick = random.Random(len(steps))
    events = [(pick.randrange(5), k, at(k * 60 + pick.randrange(-250, 250) + pick.random()), pick.choice([s for s in steps if s] + ["odd", None])) for k in range(150)]
    tied = [(7, 1000, at(500), "CREATED"), (7, 1001, at(500), "PENDING"), (7, 1002, at(500), "PENDING")]
    events = events[:40] + tied + events[40:]
    folder = Folder(spark, tmp_path, steps)
    folder.add(events[:50])
    folder.add(events[50:80])
    told = folder.run()
    assert 0 < told.count() < 80
    folder.add(events[80:])  # the query is started again from its checkpoint
    folder.run()
    log = folder.finish()
    table = spark.createDataFrame(events, EVENTS)
    assert log.count() == 153 and log.select("event_id").distinct().count() == 153
    want = states.run_machine(table, steps)
    assert rows(machine.states_of(log).select("job_id", "status", "at", "n_events", "n_refused")) == rows(want.select("job_id", "status", "at", "n_events", "n_refused"))
    # Event for event: the state after each prefix of a key's events.
    after = {}
    state = {}
    for j, i, t, s in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        ok = s in steps.get(state.get(j), ())
        state[j] = s if ok else state.get(j)
        after[i] = (state[j], ok)
    assert {r.event_id: (r.status, r.taken) for r in log.collect()} == after
    assert machine.unheard(table, log).count() == 0


def test_late_events_are_unheard(spark, tmp_path):
    folder = Folder(spark, tmp_path, states.EXPORT_STEPS)
    first = [(1, 1, at(0), "PENDING"), (1, 2, at(7200), "EXPORTED")]
    late = [(1, 3, at(60), "PROCESSING"), (2, 4, at(7000), "PENDING"), (2, 5, at(7300), "FAILED")]
    folder.add(first)
    folder.run()
    folder.add(late)
    folder.run()
    log = folder.finish()
    assert {r.event_id: (r.status, r.taken) for r in log.collect()} == {1: ("PENDING", True), 2: ("EXPORTED", True), 4: ("PENDING", True), 5: ("FAILED", True)}
    assert [r.event_id for r in machine.unheard(spark.createDataFrame(first + late, EVENTS), log).collect()] == [3]


ASKED, SAID = "request_id string, asked_at timestamp", "request_id string, answered_at timestamp, status string"


class Two:
    """Requests and replies in two folders."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        for name in ("asked", "said"):
            (path / name).mkdir()

    def add(self, asked, said):
        self.n += 1
        for name, rows_, schema in (("asked", asked, ASKED), ("said", said, SAID)):
            if rows_:
                self.spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{self.path}/tmp-{name}-{self.n}")
                (part,) = (self.path / f"tmp-{name}-{self.n}").glob("part-*.parquet")
                part.rename(self.path / name / f"{self.n:04d}.parquet")

    def run(self):
        source = lambda name, schema: self.spark.readStream.schema(schema).parquet(f"{self.path}/{name}")
        machine.write_log(correlation.correlated(source("asked", ASKED), source("said", SAID)), f"{self.path}/log", f"{self.path}/checkpoint")
        found = self.spark.read.schema("request_id string, asked_at timestamp, answered_at timestamp, status string, outcome string").parquet(f"{self.path}/log")
        return sorted((r.request_id, r.outcome, r.status) for r in found.collect())


def test_requests_and_replies(spark, tmp_path):
    two = Two(spark, tmp_path)
    two.add([("a", at(0)), ("b", at(10)), ("c", at(20)), ("e", at(30))], [("a", at(60), "completed"), ("x", at(70), "completed"), ("e", at(40), "failed"), ("e", at(41), "failed")])
    assert two.run() == [("a", "answered", "completed"), ("e", "answered", "failed")]
    # The same reply again, one before its request, one that is an hour late; and time goes on.
    two.add([("d", at(900)), ("f", at(300))], [("a", at(65), "completed"), ("d", at(950), "failed"), ("b", at(3700), "completed")])
    got = two.run()
    assert ("d", "answered", "failed") in got and got.count(("a", "answered", "completed")) == 1
    two.add([(None, at(100_000))], [(None, at(100_000), None)])
    want = [("a", "answered", "completed"), ("b", "unanswered", None), ("b", "unknown", "completed"), ("c", "unanswered", None), ("d", "answered", "failed"), ("e", "answered", "failed"), ("f", "unanswered", None), ("x", "unknown", "completed")]
    assert two.run() == want


SMALL = "/root/testdata/sf0.001"


def test_replies_are_applied_once(spark, tmp_path, monkeypatch):
    replies, before = catalog.before_replies(spark, SMALL)
    some = [r["job_id"] for r in before["jobs"].orderBy("job_id").limit(40).collect()]
    before = {n: t.where(F.col("job_id").isin(some)) for n, t in before.items() if n != "details"} | {"details": before["details"]}
    photos = before["photos"].select("photo_id")
    before["details"] = before["details"].join(photos, "photo_id", "left_semi")
    replies = replies.where(F.regexp_extract("request_id", r"\d+", 0).cast("long").isin(some + [-5])).union(replies.limit(1).withColumn("request_id", F.lit("run-nobody")))
    now = F.lit(catalog.NOW).cast("timestamp_ntz")
    want = clustering.apply_replies(replies, **before, now=now)
    store = versions.Store(spark, f"file://{tmp_path}/store")
    apply.lay_out(store, before, 8)
    (tmp_path / "drop").mkdir()
    parts = replies.collect()
    for k in range(3):
        spark.createDataFrame(parts[k::3], replies.schema).coalesce(1).write.parquet(f"{tmp_path}/tmp{k}")
        (part,) = (tmp_path / f"tmp{k}").glob("part-*.parquet")
        part.rename(tmp_path / "drop" / f"{k}.parquet")
    stream = lambda: spark.readStream.schema(replies.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/drop")
    fine = versions.Transaction.commit
    calls = []

    def fails_once(t):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("the driver is lost before the second commit")
        fine(t)
        if len(calls) == 4:
            raise OSError("and after the third, before the stream knows")

    monkeypatch.setattr(versions.Transaction, "commit", fails_once)
    for _ in range(2):
        with pytest.raises(Exception, match="lost|stream knows|OSError"):
            apply.apply_stream(stream(), store, "replies", f"{tmp_path}/checkpoint", now)
    apply.apply_stream(stream(), store, "replies", f"{tmp_path}/checkpoint", now)
    assert store.versions() == [1, 2, 3, 4] and store.applied("replies") == 2
    assert not apply.apply_batch(store, "replies", 2, replies, now)
    for name in apply.KEYS:
        columns = sorted(set(want[name].columns) & set(store.read(name).columns) - {"result"})
        text = lambda df: sorted(repr(tuple(r)) for r in df.select(*columns).collect())
        assert text(store.read(name)) == text(want[name]), name


def test_replies_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path, monkeypatch):
    """The driver would hold as many of them as there are jobs; only what was measured while a query runs may be broadcast."""
    replies, before = catalog.before_replies(spark, SMALL)
    store = versions.Store(spark, f"file://{tmp_path}/store")
    plans = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or real(self, path, *a, **k))
    limits = [spark.conf.get(k, None) for k in (shared.GUESSED, shared.MEASURED)]
    apply.lay_out(store, before, 2)
    apply.apply_batch(store, "replies", 0, replies, F.lit(catalog.NOW).cast("timestamp_ntz"))
    streams.replies_into_versions(spark, SMALL)
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]
    assert [spark.conf.get(k, None) for k in (shared.GUESSED, shared.MEASURED)] == limits


def test_files_of_replies_are_taken_in_few_tasks_and_as_they_are(spark, tmp_path, monkeypatch):
    """By Spark's own settings a batch looks up each of the files in a task of its own, and reads 32 in a task."""
    started = []
    real = DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(real(self, *a, **k)) or started[-1])
    drop = tmp_path / "drop"
    (drop / "below").mkdir(parents=True)
    for n in range(300):
        (drop / f"{n}.json").write_text(f'{{\n "request_id": "e{n}", "status": "failed", "error": "über {n}"\n}}')
    (drop / "below" / "x.json").write_text('{"request_id": "e1000", "status": "failed"}')
    (drop / "odd.json").write_bytes(b"{\xff\xfe")
    (drop / "empty.json").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")}
    got = callbacks.collected(callbacks.reply_stream(spark, str(drop))).cache()
    assert {k: spark.conf.get(k) for k in before} == before
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(str(started[0].runId)) for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 16 and sum(tasks) < 40
    assert got.count() == 301 and got.where("not readable").count() == 1
    assert {r["body"] for r in got.where("readable").collect()} == {(drop / f"{n}.json").read_text() for n in range(300)}
    requests = spark.range(100).select(F.concat(F.lit("e"), "id").alias("export_id"), F.col("id").alias("job_id"))
    events = callbacks.collected(callbacks.reply_stream(spark, str(drop)), lambda batch: callbacks.as_events(batch, requests))
    assert sorted(tuple(r) for r in events.collect()) == [(n, f"e{n}", "FAILED", f"über {n}", None) for n in range(100)]
