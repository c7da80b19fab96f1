"""Requests to the workers as a Spark data source that is written, and their replies as one that is read.

No job calls a worker: ``shotledger_outbox`` writes each request as one line of a file that a sender takes from the outbox folder. Tasks write files that nobody looks at yet; when all
tasks are done, the commit puts down one small file that names those files and nothing else, so a task that was lost and run again, or a job that failed, leaves no request twice and none by
half. In a stream the commit is named by the batch, and a batch that is run again commits nothing new.

Each request carries how often it was tried and until when an answer is waited for; ``due`` tells which are to be sent again. ``shotledger_replies`` reads replies from a folder of
such commits as a batch or a stream, whose offsets are the numbers of commits read.

The folder is one that driver and executors share, mounted as a local path, as for the reply files that workers drop.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

REQUEST = "request_id string, kind string, body string, tries int, send_until timestamp"
REPLY = "request_id string, status string, body string, commit long"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    n: int


def _plain(path: str) -> str:
    return path.removeprefix("file://")


def _publish(folder: str, name: str, entry: dict) -> bool:
    """Put down a commit at once; False if it is there."""
    os.makedirs(f"{folder}/commits", exist_ok=True)
    temporary = f"{folder}/commits/.{uuid.uuid4().hex}"
    with open(temporary, "w") as f:
        json.dump(entry, f)
    try:
        os.link(temporary, f"{folder}/commits/{name}.json")
        return True
    except FileExistsError:
        return False
    finally:
        os.remove(temporary)


def commits(folder: str) -> list[dict]:
    """The commits of a folder in their order."""
    found = []
    for name in sorted(os.listdir(f"{folder}/commits")) if os.path.isdir(f"{folder}/commits") else []:
        if name.endswith(".json") and not name.startswith("."):
            with open(f"{folder}/commits/{name}") as f:
                found.append(json.load(f))
    return found


class _Files:
    """What the batch and the stream writer share."""

    def __init__(self, options: dict):
        self.folder = _plain(options["path"])

    def _write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(f"{self.folder}/files", exist_ok=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with open(f"{self.folder}/files/{name}", "w") as f:
            for batch in iterator:
                for row in batch.to_pylist():
                    f.write(json.dumps({k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.items()}, ensure_ascii=False) + "\n")
                    n += 1
            f.flush()
            os.fsync(f.fileno())
        return Written([name], n)

    def _forget(self, messages: list) -> None:
        for m in messages:
            for name in m.names if m is not None else ():
                os.remove(f"{self.folder}/files/{name}")

    def _commit(self, messages: list, name: str) -> None:
        done = [m for m in messages if m is not None and m.n]
        if not _publish(self.folder, name, {"name": name, "files": [n for m in done for n in m.names], "n": sum(m.n for m in done)}):
            self._forget(messages)  # this batch is committed already


class _BatchWriter(_Files, DataSourceArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._write(iterator)

    def commit(self, messages: list) -> None:
        n = len(commits(self.folder))
        while not _publish(self.folder, f"{n:012d}", {"name": f"{n:012d}", "files": [x for m in messages if m is not None and m.n for x in m.names], "n": sum(m.n for m in messages if m is not None)}):
            n += 1

    def abort(self, messages: list) -> None:
        self._forget(messages)


class _StreamWriter(_Files, DataSourceStreamArrowWriter):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self._write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._forget(messages)


class Outbox(DataSource):
    """``df.write.format("shotledger_outbox").mode("append").save(folder)``, or ``writeStream``."""

    @classmethod
    def name(cls) -> str:
        return "shotledger_outbox"

    def schema(self) -> str:
        return REQUEST

    def writer(self, schema, overwrite: bool) -> _BatchWriter:
        if overwrite:
            raise ValueError("an outbox is only added to")
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options)

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema)


@dataclass
class _File(InputPartition):
    name: str
    commit: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.folder, self.names = _plain(options["path"]), schema.names
        self.kinds = {f.name: f.dataType.typeName() for f in schema.fields}

    def partitions(self) -> list[InputPartition]:
        return [_File(f, k) for k, c in enumerate(commits(self.folder)) for f in c["files"]] or [_File("", 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime as dt

        if not partition.name:
            return
        with open(f"{self.folder}/files/{partition.name}") as f:
            for line in f:
                row = json.loads(line) | {"commit": partition.commit}
                yield tuple(dt.datetime.fromisoformat(row[n]) if row.get(n) is not None and self.kinds[n].startswith("timestamp") else row.get(n) for n in self.names)


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are counts of commits; at most ``perBatch`` commits make a batch."""

    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.per_batch = int(options.get("perBatch", 100))
        self.upto = 0

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        self.upto = min(len(commits(self.folder)), self.upto + self.per_batch)
        return {"commits": self.upto}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.upto = max(self.upto, end["commits"])
        return [_File(f, start["commits"] + k) for k, c in enumerate(commits(self.folder)[start["commits"] : end["commits"]]) for f in c["files"]]

    def commit(self, end: dict) -> None:
        pass  # commits stay where they are


class Replies(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("shotledger_replies").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "shotledger_replies"

    def schema(self) -> str:
        return REPLY

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options, schema)


def register(spark) -> None:
    spark.dataSource.register(Outbox)
    spark.dataSource.register(Replies)


def due(sent: DataFrame, replies: DataFrame, now: Column, most: int = 3, wait: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """Requests to be sent again, with one try more and a new time limit, and those given up after ``most`` tries. Answered ones and those whose time isn't over are neither."""
    last = sent.groupBy("request_id").agg(F.max_by(F.struct("kind", "body", "tries", "send_until"), "tries").alias("r")).select("request_id", "r.*")
    open_ = last.join(replies.select("request_id"), "request_id", "left_anti").where(F.col("send_until") < now)
    again = open_.where(F.col("tries") < most).withColumns({"tries": F.col("tries") + 1, "send_until": now + F.expr(f"INTERVAL {wait}")})
    return again.select("request_id", "kind", "body", "tries", "send_until"), open_.where(F.col("tries") >= most).select("request_id", "tries")
