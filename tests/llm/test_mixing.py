from __future__ import annotations

import duckdb
import pytest

from shotledger.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, target string, bucket string, size string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(r) for r in rows])
    return con.execute(mixing.oracle_sql()).fetchall()


def rounded(rows):
    return sorted(((i, s, t, round(x, 6), n) for i, s, t, x, n, *_ in rows), key=repr)


def sources(n_small):
    rows = [(k, "w " * (k % 17), "big") for k in range(600)] + [(1000 + k, "w " * (k % 5 + 1), f"s{k % 7}") for k in range(n_small)]
    return rows + [(2000, "a b c", None), (2001, None, None), (None, "a b", "s1"), (2002, "", "void"), (2003, "w " * 900, "s2")]


@pytest.mark.parametrize("per_bucket", [4096, 20])
def test_against_sql(spark, per_bucket):
    rows = sources(70)
    got = mixing.curriculum(docs(spark, rows), rows_per_bucket=per_bucket).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert rounded(got) == rounded(oracle(rows))


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "w " * 10, "a")] * 100 + [(2, "w " * 700, "b")],
        [(k % 3, "w " * (k % 3 + 4), "a") for k in range(90)] + [(9, "w " * 40, "b")] * 7 + [(None, "w " * 5, None)] * 11,
        [(5, "w " * 3, "a")] * 40 + [(5, "w " * 8, "a")] * 40 + [(6, None, "b")] * 5 + [(7, "w " * 500, "b")],
    ],
)
def test_repeated_rows(spark, rows):
    got = mixing.curriculum(docs(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert rounded(got) == rounded(oracle(rows))
    assert all(r.taken <= 3 * r.size for r in got)
    sums = {}
    for r in got:  # sources differ in size here
        sums.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), own in sums.items():
        assert abs(sum(r.taken for r in own) - target) < max(1, max(r.size for r in own))


def test_takes_near_targets_and_positions(spark):
    rows = sources(300)
    got = mixing.curriculum(docs(spark, rows)).collect()
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size and len(r.positions) == r.copies * (r.target > 0)
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, max(r.size for r in own) / 2 + 1)
    # The schedules differ: sources at odd places come early.
    means = {s: sum(sum(r.positions) for r in own) / max(1, sum(r.copies for r in own)) for s, own in by.items()}
    assert means["big"] < 0.5 < means["s0"]


def test_mixed_is_in_order_and_repeats_rows(spark):
    rows = sources(70)
    frame = docs(spark, rows)
    plan = {(r.doc_id, r.size): r.copies * (r.target > 0) for r in mixing.curriculum(frame).collect()}
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    assert out.count() == sum(plan.values())
    double = frame.union(frame.where("doc_id = 2000"))
    assert mixing.mixed(double).count() > 0


def test_empty_table(spark):
    assert mixing.curriculum(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


def test_all_empty_texts(spark):
    assert {r.taken for r in mixing.curriculum(docs(spark, [(1, None, "a"), (2, "", None)])).collect()} == {0}


@pytest.mark.parametrize("per_bucket", [4096, 20])
def test_ranks_are_the_training_order(spark, per_bucket):
    rows = sources(70) + [(1001, "w w", "s1"), (1001, "w w", "s1")]
    got = mixing.scheduled(docs(spark, rows), rows_per_bucket=per_bucket).collect()
    assert rounded((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == rounded(oracle(rows))
    plan = mixing.curriculum(docs(spark, rows), rows_per_bucket=per_bucket).collect()
    assert sorted((str(r.doc_id), r.size, r.positions) for r in got) == sorted((str(r.doc_id), r.size, r.positions) for r in plan)
    copies = sorted((n, p, r.source is not None, r.source or "") for r in got for n, p in zip(r.ranks, r.positions, strict=True))
    assert [n for n, *_ in copies] == list(range(len(copies))) and len(copies) > 500
    assert [c[1:] for c in copies] == sorted(c[1:] for c in copies)


def test_query_returns_the_whole_curriculum(spark):
    got = queries.QUERIES["op9_time_varying_curriculum"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "size", "source_size", "target", "taken", "positions", "ranks"} == set(got.columns)
    got = got.collect()
    order = sorted((n, p) for r in got for n, p in zip(r.ranks, r.positions, strict=True))
    assert [n for n, _ in order] == list(range(len(order))) and [p for _, p in order] == sorted(p for _, p in order)
    assert all(r.taken == r.size * len(r.ranks) for r in got) and any(r.ranks for r in got)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(mixing.oracle_sql()).fetchall()
    whole = lambda rows: sorted((r[0], r[1], r[2], round(r[3], 6), r[4], list(r[5]), list(r[6])) for r in rows)
    assert whole(want) == whole(r for r in map(tuple, (spark.createDataFrame(got).select("doc_id", "size", "source_size", "target", "taken", "positions", "ranks").collect())))
