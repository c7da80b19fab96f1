from __future__ import annotations

import threading
from pathlib import Path

import pytest

from shotledger.sources import shared


def folders(spark):
    return {p.name for p in Path(shared.shared_dir(spark).removeprefix("file://")).glob("shotledger-*")}


def test_tables_of_a_scratch_go_with_it(spark):
    rows = spark.range(5).toDF("a")
    before = folders(spark)
    with shared.scratch(spark) as kept:
        shared.materialise(rows, "gone")
        with shared.scratch(spark) as inner:
            shared.materialise(rows, "gone too")
            middle = inner(rows, "middle")
        out = kept(middle.where("a > 2"), "out")
        assert middle.count() == 5 and len(folders(spark) - before) == 3
    assert sorted(r.a for r in out.collect()) == [3, 4] and len(folders(spark) - before) == 1
    with pytest.raises(ZeroDivisionError), shared.scratch(spark):
        shared.materialise(rows, "failed")
        1 / 0
    assert len(folders(spark) - before) == 1
    assert shared.materialise(rows.limit(0), "empty").dtypes == rows.dtypes


def test_threads_have_scratches_of_their_own(spark):
    opened, written = threading.Barrier(2, timeout=60), {}

    def long_lived():
        with shared.scratch(spark) as kept:
            opened.wait()
            opened.wait()
            written["long"] = kept(spark.range(3).toDF("a"), "kept")

    def short_lived():
        opened.wait()
        written["apart"] = shared.materialise(spark.range(4).toDF("a"), "apart")
        opened.wait()

    threads = [threading.Thread(target=f) for f in (long_lived, short_lived)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert written["apart"].count() == 4 and written["long"].count() == 3


def test_only_tables_of_a_proven_size_are_broadcast(spark):
    texts = shared.materialise(spark.range(10).selectExpr("id", "repeat('x', 1000) as t", "array(id) as l"), "texts")
    assert 10_000 < shared.size_in_bytes(texts) < 12_000
    assert "ResolvedHint" in shared.broadcast_if_small(texts, 20_000)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in shared.broadcast_if_small(texts, 5_000)._jdf.queryExecution().analyzed().toString()
