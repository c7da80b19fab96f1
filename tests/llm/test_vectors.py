from __future__ import annotations

import numpy as np
import pytest

from shotledger.llm import vectors


def brute(rows, least):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    n, label, links = [0] * len(rows), list(range(len(rows))), []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    change = True
    while change:
        change = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                change = True
    group = {}
    for k, x in enumerate(label):
        group.setdefault(x, []).append(ids[k])
    low = {x: min((i for i in g if i is not None), default=None) for x, g in group.items()}
    return sorted(((ids[k], n[k], low[label[k]], ids[k] == low[label[k]]) for k in range(len(rows))), key=repr)


def sample(seed, families=12):
    pick = np.random.default_rng(seed)
    rows = []
    for _ in range(families):
        centre = pick.normal(size=8)
        for _ in range(int(pick.integers(1, 30))):
            rows.append((len(rows), (centre + pick.normal(size=8) * pick.choice([0.02, 0.15, 0.3])).astype(np.float32).astype(float).tolist()))
    rows += [(len(rows) + k, pick.normal(size=8).astype(np.float32).astype(float).tolist()) for k in range(100)]
    a = rows[0][1]
    return rows + [(5000, a), (5001, a), (5001, a), (5002, [2 * x for x in a]), (5003, None), (5004, [0.0] * 8), (5005, [float("nan")] + a[1:]), (5006, a[:7]), (5010, a[:7]), (5011, a[:7][::-1]), (5007, [None] + a[1:]), (5008, []), (5009, [float("inf")] + a[1:])]


def run(spark, rows, kind="float", **options):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, node string")
    return sorted((tuple(r) for r in vectors.link_classes(table, **options).collect()), key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_probes_find_all_links(spark, kind):
    rows = sample(1)
    assert run(spark, rows, kind, probes=64) == brute(rows, 0.9)
    assert run(spark, rows, kind) == brute(rows, 0.9)


def test_recall_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 16)
    monkeypatch.setattr(vectors, "QUERIES", 32)
    rows = sample(2, 25)
    want, got = brute(rows, 0.9), run(spark, rows, lists=32, probes=6)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


@pytest.mark.parametrize("spread", [0.2, 0.3])
def test_hot_group_of_near_copies_keeps_its_links(spark, spread):
    """A third of the rows are distinct near copies: by certain bounds no link is lost, by the default nearly none."""
    pick = np.random.default_rng(5)
    centre = pick.normal(size=64)
    x = np.concatenate([centre + pick.normal(size=(3000, 64)) * spread, pick.normal(size=(6000, 64))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = [int((part @ unit.T >= 0.9).sum()) - 1 for part in unit[:, None]]
    rows = list(enumerate(x.astype(float).tolist()))
    got = {r[0]: r for r in run(spark, rows)}
    assert sum(want) > 1_000_000 and all(got[k][1] <= want[k] for k in range(len(x)))
    recall = sum(r[1] for r in got.values()) / sum(want)
    assert recall >= 0.999, recall
    sure = {r[0]: r for r in run(spark, rows, certainty=None)}
    assert [sure[k][1] for k in range(len(x))] == want
    if spread == 0.2:
        assert {got[k][2] for k in range(3000)} == {0}


def test_many_small_groups_are_found(spark):
    pick = np.random.default_rng(6)
    x = np.repeat(pick.normal(size=(1500, 64)), 4, axis=0)
    x = (x + pick.normal(size=x.shape) * pick.choice([0.05, 0.2, 0.3], size=(len(x), 1))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = [int((part @ unit.T >= 0.9).sum()) - 1 for part in unit[:, None]]
    got = {r[0]: r[1] for r in run(spark, list(enumerate(x.astype(float).tolist())))}
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.999 * sum(want) > 0


def test_nothing_to_link(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0] * 8)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert run(spark, [(1, [1.0] * 8)]) == [(1, 0, 1, True)]


def test_sql_says_the_same():
    import duckdb

    rows = sample(3, 6)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [[i, v] for i, v in rows])
    assert sorted(con.execute(vectors.oracle_sql()).fetchall(), key=repr) == brute(rows, 0.9)
