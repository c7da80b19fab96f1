from __future__ import annotations

import hashlib
import zlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotledger.llm import suffixes


def brute(rows, length=100):
    """Every string of ``length`` bytes in the order of ids and places."""
    return sorted((x for x, _ in brute_kept(rows, length)), key=repr)


def brute_kept(rows, length=100):
    """The digests and the bytes left of each row."""
    seen, out = {}, []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], hashlib.sha256((r[1] or "").encode()).digest())):
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            g = raw[s : s + length]
            if seen.setdefault(g, (i, t, s)) != (i, t, s):
                cover[s : s + length] = True
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = int(np.sum(np.diff(cover[:-1].astype(int), prepend=0) == 1)) if len(raw) else 0
        out.append(((i, t), ((i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()), kept)))
    found = dict(out)
    return [found[r] for r in rows]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, at string, spans string")
    return sorted((tuple(r) for r in suffixes.digest(suffixes.without_repeats(docs)).collect()), key=repr)


def sample(seed):
    pick = random.Random(seed)
    words = ["the", "of", "ätt", "thing", "and", "ß", "\n", "lorem"]
    text = lambda n: " ".join(pick.choice(words) + str(pick.randrange(60)) for _ in range(n))
    passages = [text(n) for n in (30, 45, 60, 200)]
    rows = [(None, None), (1, ""), (2, "x" * 99), (3, "x" * 250), (4, "x" * 101), (5, "ab" * 300), (6, passages[0])]
    for k in range(60):
        parts = [text(pick.randrange(40)) for _ in range(3)]
        rows.append((100 + pick.randrange(10**6), parts[0] + pick.choice(passages) + parts[1] + pick.choice(passages)[pick.randrange(60) :] + parts[2]))
    rows += [(7, rows[10][1]), (8, rows[10][1]), (9, passages[3] * 3), (10, "é" * 120), (11, "é" * 120 + "e")]
    return rows


def test_against_brute_force(spark):
    rows = sample(5)
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a" + "bcdefghij" * 30), (1, "a" + "bcdefghij" * 30), (2, "a" + "bcdefghij" * 30)]
    assert run(spark, rows) == brute(rows)


def test_crowded_anchors_are_divided(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_WINDOWS", 3)
    rows = sample(6)
    assert run(spark, rows) == brute(rows)


def test_one_line_in_all_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_WINDOWS", 8)
    pick = random.Random(4)
    text = lambda n: "".join(pick.choice("abcdefgh ") for _ in range(n))
    line, tails = text(70), [text(60) for _ in range(6)]
    rows = [(k, text(pick.randrange(50)) + pick.choice(tails)[pick.randrange(30) :] + line + pick.choice(tails)[: pick.randrange(60)] + text(20)) for k in range(120)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("most", [512, 3])
def test_groups_and_equal_windows_cover_what_goes(spark, monkeypatch, most):
    """All that is removed follows from the groups' occurrences but the earliest, and from windows equal to an earlier one; and nothing else does."""
    monkeypatch.setattr(suffixes, "GROUP_WINDOWS", most)
    rows = [r for r in sample(12) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_number = suffixes.numbered(docs)
    number = {(r.doc_id, r.text): r.number for r in by_number.collect()}
    text = {number[i, t]: (t or "").encode() for i, t in rows}
    groups = {}
    for r in suffixes.repeat_groups(docs).collect():
        groups.setdefault((r.grp, r.size), set()).add((r.number, r.start))
    gone = {k: np.zeros(len(t), bool) for k, t in text.items()}
    for (_, size), spots in groups.items():
        assert size >= 100 and len(spots) > 1 and len({text[i][a : a + size] for i, a in spots}) == 1
        for i, a in sorted(spots)[1:]:
            gone[i][a : a + size] = True
    _, covered = suffixes._windows(by_number.select(F.col("number").alias("doc_id"), "text"), 100)
    for part in covered:
        for r in suffixes._placed(part).collect():
            gone[r.doc_id][r.start : r.stop] = True
    assert len(groups) > 20
    want = {number[i, t]: kept for (i, t), (_, kept) in zip(rows, brute_kept(rows))}
    assert {k: bytes(np.frombuffer(t, np.uint8)[~gone[k]]) for k, t in text.items()} == want


def test_long_texts_in_pieces(spark, monkeypatch):
    pick = random.Random(9)
    body = "".join(chr(97 + pick.randrange(26)) for _ in range(700_000))
    rows = [(1, body), (2, body[600_000:] + body[:200])]
    got = run(spark, rows)
    assert [r[2] for r in got] == [0, 100_200]


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(5))
def test_maximal_repeats_have_all_occurrences(seed):
    pick = random.Random(seed)
    parts = ["".join(pick.choice("ab") for _ in range(pick.randrange(8, 60))).encode() for _ in range(6)]
    length = 5
    got = {}
    for size, part, place in suffixes.maximal_repeats(parts, length):
        spots = frozenset(zip(part.tolist(), place.tolist()))
        strings = {parts[p][q : q + size] for p, q in spots}
        assert len(strings) == 1
        got[strings.pop()] = spots
    every = {}
    for p, t in enumerate(parts):
        for n in range(length, len(t) + 1):
            for q in range(len(t) - n + 1):
                every.setdefault(t[q : q + n], set()).add((p, q))
    for text, spots in every.items():
        lefts = {parts[p][q - 1] if q else None for p, q in spots}
        rights = {parts[p][q + len(text)] if q + len(text) < len(parts[p]) else (p, q) for p, q in spots}
        if len(spots) > 1 and (len(lefts) > 1 or None in lefts) and len(rights) > 1:
            assert got.get(text) == spots, text
    assert all(every[t] == s for t, s in got.items())


def test_cleaned_keeps_all_rows_and_columns(spark):
    passage = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "start " + passage, "s", 3), (2, passage, "s", 3), (3, None, None, None)], "doc_id long, text string, source string, n_chars long")
    rows = {r.doc_id: r for r in suffixes.cleaned(docs).collect()}
    assert set(rows) == {1, 2, 3} and rows[2].text == "" and rows[2].n_chars == 0 and rows[1].text == "start " + passage and rows[1].source == "s"


def test_sql_says_the_same():
    import duckdb

    rows = [r for r in sample(8) if r[0] is not None] + [(None, "z" * 150)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(con.execute(suffixes.oracle_sql()).fetchall(), key=repr) == brute(rows)


def test_texts_of_one_id_are_told_apart(spark):
    """Two texts of one id whose CRC-32 agree in the lower 20 bits, one of which repeats an earlier document; and many texts without an id."""
    first = "a passage that stands in two documents and is longer than one hundred bytes, so that the second of them loses it all"
    seen, pair = {}, None
    for k in range(1 << 14):
        clean = f"{k} nothing of this stands anywhere else, {k * 7919} however long one looks for it, and it is {k * 104729} bytes in all or more"
        seen[zlib.crc32(clean.encode()) & 0xFFFFF] = clean
    for k in range(1 << 14):
        dirty = f"{k} {first}"
        if (clean := seen.get(zlib.crc32(dirty.encode()) & 0xFFFFF)) is not None:
            pair = clean, dirty
            break
    rows = [(1, first), (7, pair[0]), (7, pair[1])] + [(None, f"{k} of the rows without an id") for k in range(300)] + [(None, first), (None, first)]
    got = sorted((tuple(r) for r in suffixes.digest(suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()), key=repr)
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] == 7 and r[1] == len(pair[0].encode())] == [0]
