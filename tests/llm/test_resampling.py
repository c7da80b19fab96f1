from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shotledger.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature, buckets=10000):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10000) / ((s[b] + 1.0) * (n_t + 10000))))
    rows = []
    for k, (i, x) in enumerate(docs):
        w, f = features(x)
        weight = sum(gain(bucket(g)) for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 é中\n-\x00\x7f𝄞", max_size=40)), max_size=8), st.sampled_from([1, 20, 1 << 20]))
def test_runs_and_hashes(texts, size):
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    old, resampling.SLICE_BYTES = resampling.SLICE_BYTES, size
    try:
        parts = [resampling.Runs(p.column(0)) for p in resampling.slices(batch, 0)]
    finally:
        resampling.SLICE_BYTES = old
    total = sum((p.counts(97) for p in parts), np.zeros(97, np.int64))
    want = Counter(bucket(g, 97) for x in texts for g in features(x)[1])
    assert {k: n for k, n in enumerate(total) if n} == dict(want)
    gains = np.arange(97) * 7 - 300
    n = [x for p in parts for x in p.sums(gains)[0]]
    sums = [x for p in parts for x in p.sums(gains)[1]]
    assert n == [len(features(x)[1]) for x in texts] and sums == [sum(int(gains[bucket(g, 97)]) for g in features(x)[1]) for x in texts]


def test_moved_hash_of_long_words():
    a, b = b"x" * 100_003, "ä".encode() * 70_001
    got = resampling.moved(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
    assert got[0] == zlib.crc32(a + b)


def run(spark, docs, target, **options):
    rows = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, row int, weight string, n_words int")
    got = resampling.resample(rows, spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), **options).collect()
    return Counter(tuple(r) for r in got)


def test_against_brute_force(spark):
    pick = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma9", "été", "中文", "x" * 5000, "d-e", "q"]
    docs = [(int(i), " ".join(pick.choice(words, int(pick.integers(0, 60))))) for i in range(150)]
    docs += [(7, None), (8, ""), (None, docs[3][1]), (None, docs[3][1]), (9, " . - "), (10, "a\x00b" * 400_000)] + [docs[5]] * 30
    target = ["alpha beta gamma9 alpha", None, "", "été q q q"]
    assert run(spark, docs, target) == brute(docs, target)
    assert run(spark, docs, target, percent=50) == brute(docs, target, 50)
    assert run(spark, docs, [], percent=100) == brute(docs, [], 100)


def test_empty_table(spark):
    assert run(spark, [], ["a b c"]) == Counter()
