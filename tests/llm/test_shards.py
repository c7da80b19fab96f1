from __future__ import annotations

import hashlib

import numpy as np
import pytest

from shotledger.llm import shards, tokens
from shotledger.sources.shared import new_folder


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(count):
    x = np.arange(count)
    y = shards.permute(x, count, 5)
    assert sorted(y.tolist()) == x.tolist()
    assert shards.permute(y, count, 5, inverse=True).tolist() == x.tolist()
    if count > 100:
        assert (y != shards.permute(x, count, 6)).mean() > 0.9 and (y != x).mean() > 0.9


ROWS = [(k, f"text number {k} " * (k % 30)) for k in range(400)] + [(None, None), (1, ""), (7, "long " * 20_000), (7, "long " * 20_000), (7, "other")]


def numbered(rows, length, buckets):
    """All sequences in the order of their numbers, slowly and apart from the operator: buckets in order, documents by id and text."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_paths()[0])
    out = []
    for own in buckets:
        stream = []
        for k in sorted(own, key=lambda k: (rows[k][0] is not None, rows[k][0], hashlib.md5((rows[k][1] or "").encode()).hexdigest())):
            stream += [*whole.encode(rows[k][1] or "", add_special_tokens=False).ids, 2]
        stream += [2] * (-len(stream) % length)
        out += [stream[i : i + length] for i in range(0, len(stream), length)]
    return out


def bucketed(spark, rows, bucket_rows):
    """Numbers of the rows in each bucket, by Spark's own hash."""
    n = max(1, -(-len(rows) // bucket_rows))
    keyed = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k int, i long, t string").selectExpr("k", f"pmod(xxhash64(cast(i as string), md5(coalesce(t, ''))), {n}) as b")
    found = [[] for _ in range(n)]
    for r in keyed.collect():
        found[r.b].append(r.k)
    return found


@pytest.mark.parametrize("bucket_rows", [100, 4096])
def test_round_trip(spark, bucket_rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in ROWS], "doc_id long, text string, slot long, bucket long, ids string").repartition(3)
    manifest = shards.write_shards(docs, new_folder(spark, "shards"), length=64, per_shard=16, key=9, bucket_rows=bucket_rows)
    want = numbered(ROWS, 64, bucketed(spark, ROWS, bucket_rows))
    count = len(want)
    got = shards.read_shards(manifest, 64).collect()
    assert sorted(r.slot for r in got) == list(range(count))
    for r in got:
        number = int(shards.permute(np.array([r.slot]), count, 9, inverse=True)[0])
        assert np.frombuffer(r.ids, "<u2").tolist() == want[number]
        assert (r.shard, r.byte_offset) == (r.slot // 16, r.slot % 16 * 128)
    part = shards.read_shards(manifest, 64, start=20, stop=50).collect()
    assert sorted(r.slot for r in part) == list(range(20, 50))
    assert {tuple(r) for r in part} <= {tuple(r) for r in got}
    files = manifest.collect()
    assert sum(m.n_sequences for m in files) == count and all(m.n_bytes == m.n_sequences * 128 for m in files)


def test_layout_does_not_matter(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = []
    for docs in (frame.repartition(1), frame.repartition(3, "text"), frame.orderBy("text").repartition(7)):
        manifest = shards.write_shards(docs, new_folder(spark, "shards"), length=64, per_shard=16, key=9, bucket_rows=100)
        found.append(sorted((m.shard, m.first_slot, m.n_sequences, m.crc32) for m in manifest.collect()))
    assert found[0] == found[1] == found[2]


def test_wide_vocabularies_get_wide_ids(monkeypatch):
    assert shards.id_width(tokens.default_paths()) == 2
    monkeypatch.setattr(shards, "vocabulary_size", lambda paths: 65_537)
    assert shards.id_width(tokens.default_paths()) == 4


def test_materialised_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.slot, r.number) for r in shards.materialised(docs, 8, 4).collect()] == [(0, 0)]
    assert shards.materialised(docs.limit(0), 8, 4).count() == 0
