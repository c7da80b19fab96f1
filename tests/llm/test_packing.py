from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotledger.llm import packing, tokens
from shotledger.sources.shared import scratch


def test_ids_equal_the_tokenizers_library():
    json_path, ranks = tokens.default_paths()
    whole = Tokenizer.from_file(json_path)
    texts = ["", "Hello  world\n\n\tx", "ééé ßß 漢字 🙂", "a<|endoftext|>b", "x" * 5000, "  " * 300 + "z", "It's we'll I'm 12345 !!??", None]
    for t, ids in zip(texts, tokens.id_arrays(pa.array(texts), (json_path, ranks))):
        assert ids.tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("seed", range(20))
def test_bound_and_packing(seed):
    pick = random.Random(seed)
    n = pick.randrange(1, 60)
    lengths = np.array([pick.choice([pick.randrange(1, 101), 34, 51, 50, 99]) for _ in range(n)])
    bins, offsets, count = packing.best_fit(lengths, 100)
    assert packing.lower_bound(lengths, 100) <= count
    for b in range(count):
        own = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
        at = 0
        for o, x in own:
            assert o == at
            at += x
        assert 0 < at <= 100


def fewest(lengths, size):
    """The least number of sequences, by trying all ways."""
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[k]}):
            i = rooms.index(room)
            put(k + 1, rooms[:i] + [room - lengths[k]] + rooms[i + 1 :])
        put(k + 1, [*rooms, size - lengths[k]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bound_and_packing_against_the_optimum(seed):
    pick = random.Random(1000 + seed)
    lengths = sorted((pick.choice([pick.randrange(1, 101), pick.randrange(20, 60), 34, 51]) for _ in range(pick.randrange(1, 11))), reverse=True)
    least = fewest(lengths, 100)
    assert packing.lower_bound(np.array(lengths), 100) <= least <= packing.best_fit(np.array(lengths), 100)[2] <= 11 / 9 * least + 1


def test_bound_beats_volume():
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 9), 100) == 5


def rows():
    pick = random.Random(4)
    texts = [" ".join(pick.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(pick.randrange(1, 900))) for _ in range(150)]
    return [(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "word " * 9000), (3, "again"), (3, "again"), (None, "no id")]


@pytest.mark.parametrize("per_partition", [32768, 40])
def test_sequences(spark, per_partition):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows()], "doc_id long, text string, part long")
    got = packing.pack(docs, per_partition=per_partition).collect()
    encode = tokens.encoder(*tokens.default_paths())
    want = defaultdict(int)
    for i, t in rows():
        ids = np.array([*encode(t or ""), 2], np.uint32)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())] += 1
    have = defaultdict(int)
    seqs = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        seqs[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    # The certificates: what a partition is said to need at least is no more than what it was packed into, and certified ones are packed into that.
    assert all(r.part_bound <= r.part_sequences for r in got)
    if per_partition > 1000:
        mixed = [r for r in got if r.length < 1024]
        (bound,) = {r.part_bound for r in mixed}
        assert packing.lower_bound(np.array([r.length for r in mixed]), 1024) == bound <= len({r.sequence_id for r in mixed}) == mixed[0].part_sequences
    least = -(-sum(r.length for r in got) // 1024)
    assert len(seqs) <= least * 1.02 + (2 if per_partition > 1000 else 6)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_pieces_are_dealt_out(spark):
    rows = spark.range(0, 20_000, 1, 4).selectExpr("7L AS doc_id", "0 AS piece", "0L AS start", "300L AS length", "5L AS ids_crc32")
    with scratch(spark) as kept:
        got = kept(packing.pack_pieces(rows, per_partition=4000), "packed")
    parts = [r["n"] for r in got.groupBy(F.floor(F.col("sequence_id") / (1 << 20)).alias("part")).agg(F.countDistinct("sequence_id").alias("n")).collect()]
    assert len(parts) == 5 and max(parts) < 2000 and got.count() == 20_000
    assert got.select("sequence_id").distinct().count() <= 20_000 / 3 + 5
