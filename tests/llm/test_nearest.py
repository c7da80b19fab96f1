from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotledger.llm import nearest
from shotledger.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k, every):
    out = []
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v)]
    for a, (q, v) in enumerate(ok):
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for b, (i, w) in enumerate(ok) if b != a and len(w) == len(v))
            out += [(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def run(spark, rows, k, every, kind="float", **options):
    data = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, node int, raw string, score int")
    got = nearest.nearest(data, F.col("vec_id") % every == 0, k, **options).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got)


def sample(seed, n=300, d=20):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(6, d))
    rows = [(int(i), (centres[i % 6] + 0.3 * pick.normal(size=d)).astype(np.float32).astype(float).tolist()) for i in range(n)]
    a = rows[0][1]
    rows += [(1000 + i, a) for i in range(40)] + [(1000, a), (1000, a), (2000, [float(np.float32(3 * x)) for x in a]), (2000, rows[9][1]), (None, a), (2010, None), (2020, []), (2030, [0.0] * d), (2040, [float("nan")] + a[1:])]
    return rows + [(2050, [None] + a[1:]), (2060, [float("inf")] + a[1:]), (2070, a[:3]), (2071, a[1:4]), (2080, a[:1]), (2090, [5.0]), (2091, [-5.0])]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_lists_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "MEMBERS", 32)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    rows = sample(1)
    assert run(spark, rows, 10, 10, kind, certainty=None, deviations=1e9) == brute(rows, 10, 10)


def test_few_rows(spark):
    rows = sample(2)[:4] + sample(2)[-8:]
    assert run(spark, rows, 10, 1) == brute(rows, 10, 1)
    assert run(spark, [], 10, 1) == []
    assert run(spark, [(0, [1.0, 2.0])], 10, 1) == []


def test_a_copy_group_beyond_k(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 20)]
    assert run(spark, rows, 10, 50) == brute(rows, 10, 50)


def test_recall_with_bounds(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MEMBERS", 64)
    rows = sample(3, n=2000, d=48)
    want = brute(rows, 10, 20)
    got = {(q, i) for q, _, i, _ in run(spark, rows, 10, 20)}
    assert len(got & {(q, i) for q, _, i, _ in want}) >= 0.98 * len({(q, i) for q, _, i, _ in want})


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
    want = brute(rows, 10, 100)
    got = QUERIES["op13_adaptive_dimension_scan"](spark, SF).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(got) == len(want) and len(found & {(q, i) for q, _, i, _ in want}) >= 0.95 * len(want)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(abs(exact[r["query_id"], r["vec_id"]] - r["score"]) < 1e-8 for r in got if (r["query_id"], r["vec_id"]) in exact)


def test_abandoning_drops_few_neighbours():
    pick = np.random.default_rng(0)
    m, q = pick.normal(size=(3000, 96)), pick.normal(size=(40, 96))
    index = nearest.Index(m, 8)
    exact = np.sqrt(((q[:, None] - m[None]) ** 2).sum(2))
    reach = np.sort(exact, 1)[:, 9] * 1.0001
    i, j, score = nearest.scan_block(index, q, m, None, reach, 10, np.arange(len(m)), 3.0)
    assert len(i) >= 0.98 * 400 and np.allclose(score, exact[i, j])
