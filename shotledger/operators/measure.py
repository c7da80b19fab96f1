"""What running queries take: rows, time and memory of each run, as rows that the histograms are made of."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

RUN = "task string, began timestamp_ntz, ended timestamp_ntz, before long, after long, n_rows long"


class Recorder:
    """Collects the runs of tasks; ``rows`` gives them as a table for ``relations.deltas`` and ``relations.histogram``. Bounded: the last ``most`` runs stay."""

    def __init__(self, spark: SparkSession, most: int = 10_000):
        self.spark, self.most = spark, most
        self._runs: list[tuple] = []
        self._lock = threading.Lock()

    def _memory(self) -> int:
        runtime = self.spark._jvm.java.lang.Runtime.getRuntime()  # noqa: SLF001
        return runtime.totalMemory() - runtime.freeMemory()

    def add(self, task: str, began: dt.datetime, ended: dt.datetime, before: int, after: int, n_rows: int | None) -> None:
        with self._lock:
            self._runs = [*self._runs, (task, began, ended, before, after, n_rows)][-self.most :]

    @contextmanager
    def task(self, name: str, n_rows: Callable[[], int | None] = lambda: None) -> Iterator[None]:
        """One run of what stands inside; a run that fails counts too."""
        began, before = dt.datetime.now(), self._memory()
        try:
            yield
        finally:
            self.add(name, began, dt.datetime.now(), before, self._memory(), n_rows())

    def run(self, name: str, df: DataFrame, action: Callable[[DataFrame], Any]) -> Any:
        """The action's result; rows are counted as they pass, without a second run."""
        seen = Observation()
        counts: list[int] = []
        with self.task(name, lambda: counts[0] if counts else None):
            found = action(df.observe(seen, F.count(F.lit(1)).alias("n_rows")))
            counts.append(seen.get["n_rows"])
        return found

    def listener(self) -> StreamingQueryListener:
        """For ``spark.streams.addListener``: a run for each batch of a named stream, with the rows that came in."""
        recorder = self

        class Batches(StreamingQueryListener):
            def onQueryStarted(self, event: Any) -> None:
                pass

            def onQueryProgress(self, event: Any) -> None:
                p = event.progress
                began = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)
                recorder.add(p.name or str(p.id), began, began + dt.timedelta(milliseconds=p.batchDuration), 0, 0, p.numInputRows)

            def onQueryIdle(self, event: Any) -> None:
                pass

            def onQueryTerminated(self, event: Any) -> None:
                pass

        return Batches()

    def rows(self) -> DataFrame:
        with self._lock:
            return self.spark.createDataFrame(self._runs, RUN)
