"""Training-order materialisation: token sequences written to fixed-stride shards in a keyed random order.

1. Documents are dealt to buckets by a hash of id and text, in number by the count of documents alone, and sorted within by id and text. A bucket's
   ids, each document's with the end id, are laid end to end and cut into sequences of ``length`` ids; the last one of a bucket is
   padded with the end id. Sequences are numbered densely from 0 by bucket and place. So numbers depend on the documents, not on how they are laid out.
2. A keyed Feistel permutation over the next power of two sends number to slot; results outside the count are sent through again (cycle
   walking), so that every sequence gets a slot of its own and the order can be computed, and inverted, without any table.
3. A shard is the range of ``per_shard`` slots from its number on, and a task gets a range of shards. It sorts them by slot and writes each as one file of
   little-endian ids, of 16 bits if the vocabulary has no more than 65,536 ids, else of 32: sequence ``s`` lies in shard ``s // per_shard`` at
   byte ``(s % per_shard) * stride``, which is all a reader needs to start or go on anywhere.

A task that is run again writes files with new names; the manifest has those that Spark accepted. Defined results: null and empty texts give
the end id alone; an empty table gives no sequences and no shards; repeated rows are written each, and rows with one id are ordered by their texts; a
null id comes first; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotledger.llm.tokens import END_ID, default_paths, id_arrays, vocabulary_size
from shotledger.sources.shared import materialise, new_folder, scratch

ROUNDS, BUCKET_ROWS = 6, 4096
#: What a compression dictionary is trained on at most: so many documents and so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 8192


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    x = x ^ np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, count: int, key: int, inverse: bool = False) -> np.ndarray:
    """Where a keyed permutation of ``range(count)`` sends each number, or with ``inverse`` where it comes from."""
    bits = max(2, int(count - 1).bit_length())
    low = bits // 2
    x = numbers.astype(np.uint64)
    out = np.ones(len(x), bool)
    while out.any():
        y = x[out]
        # Halves of unequal size change places each round, so the widths do too.
        widths = [(bits - low, low) if r % 2 == 0 else (low, bits - low) for r in range(ROUNDS)]
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            left, right = (np.uint64(w) for w in widths[r])
            mask = lambda w: (np.uint64(1) << w) - np.uint64(1)
            if not inverse:
                a, b = y >> right, y & mask(right)
                y = (b << left) | (a ^ (_round(b, key, r) & mask(left)))
            else:
                b, a = y >> left, y & mask(left)
                y = ((a ^ (_round(b, key, r) & mask(left))) << right) | b
        x[out] = y
        out[out] = y >= np.uint64(count)
    return x.astype(np.int64)


def id_width(paths: tuple[str, str]) -> int:
    """Bytes of an id on disk."""
    return 2 if vocabulary_size(paths) <= 1 << 16 else 4


def trained(docs: DataFrame, length: int, paths: tuple[str, str], rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> bytes | None:
    """A compression dictionary for sequences from a few documents; nothing but the bytes on the way depends on it."""
    some = [r["text"] for r in docs.select(F.substring("text", 1, chars).alias("text")).limit(rows).collect()]
    ids = np.concatenate([np.zeros(0, np.uint32), *id_arrays(pa.array(some, pa.string()), paths)]).astype(f"<u{id_width(paths)}")
    try:
        return zstandard.train_dictionary(112_640, [ids[k : k + length].tobytes() for k in range(0, len(ids), length)], k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return None


def _dictionary(raw: bytes | None) -> zstandard.ZstdCompressionDict | None:
    return None if raw is None else zstandard.ZstdCompressionDict(raw)


def sequences(docs: DataFrame, length: int = 1024, paths: tuple[str, str] | None = None, dictionary: bytes | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``bucket, place, ids`` of every sequence; ids compressed, as they are written, shuffled and only then laid out."""
    paths = paths or default_paths()
    kind = f"<u{id_width(paths)}"
    buckets = max(1, math.ceil(docs.count() / bucket_rows))
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    keyed = keyed.select(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "digest"), F.lit(buckets)).alias("bucket"), "doc_id", "digest", "text")
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids = [x.astype(kind).tobytes() for x in id_arrays(part.column(3), paths)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.binary())], ["bucket", "doc_id", "digest", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=9, dict_data=_dictionary(dictionary))
        now, place, rest = None, 0, np.zeros(0, kind)

        def rows(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal place
            n = len(ids) // length
            place += n
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, now, np.int64)), pa.array(np.arange(place - n, place)), pa.array([press.compress(x.tobytes()) for x in ids.reshape(n, length)], pa.binary())], ["bucket", "place", "ids"]
            )

        for batch in batches:
            held: list[np.ndarray] = []
            for bucket, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now:
                    if now is not None:
                        left = np.concatenate([rest, *held])
                        if len(left):
                            yield rows(np.concatenate([left, np.full(-len(left) % length, END_ID, kind)]))
                    now, place, rest, held = bucket, 0, np.zeros(0, kind), []
                held.append(np.frombuffer(ids.as_buffer(), kind))
            ids = np.concatenate([rest, *held])
            upto = len(ids) - len(ids) % length
            rest = ids[upto:]
            if upto:
                yield rows(ids[:upto])
        if len(rest):
            yield rows(np.concatenate([rest, np.full(-len(rest) % length, END_ID, kind)]))

    encoded = keyed.mapInArrow(encode, f"bucket long, doc_id {id_kind}, digest string, ids binary")
    sorted_ = encoded.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "digest")
    return sorted_.select("bucket", "ids").mapInArrow(cut, "bucket long, place long, ids binary")


def write_shards(docs: DataFrame, folder: str, length: int = 1024, per_shard: int = 8192, key: int = 1, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The manifest ``shard, path, first_slot, n_sequences, n_bytes, crc32``; all sequences are numbered, permuted and written."""
    with scratch(docs.sparkSession) as kept:
        return kept(_written(docs, folder, length, per_shard, key, bucket_rows), "manifest")


def _written(docs: DataFrame, folder: str, length: int, per_shard: int, key: int, bucket_rows: int) -> DataFrame:
    paths = default_paths()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    dictionary = trained(docs, length, paths)
    made = materialise(sequences(docs, length, paths, dictionary, bucket_rows), "sequences")
    counts = made.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row per bucket.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    count = starts.agg(F.sum("n")).first()[0] or 0
    numbered = made.join(starts.select("bucket", "base"), "bucket").select((F.col("base") + F.col("place")).alias("number"), "ids")
    n_shards = max(1, math.ceil(count / per_shard))
    tasks = min(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * max(1, n_shards // 4096))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column(0).to_numpy(), count, key)
            shard = slot // per_shard
            yield pa.RecordBatch.from_arrays([pa.array((shard * tasks // n_shards).astype(np.int32)), pa.array(shard), pa.array(slot), batch.column(1)], ["task", "shard", "slot", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = now = None
        found: list[dict] = []
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for shard, slot, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if now is None or shard != now["shard"]:
                    if out is not None:
                        out.close()
                    now = {"shard": shard, "path": f"{folder}/{shard:08d}-{uuid.uuid4().hex}.bin", "first_slot": slot, "n_sequences": 0, "n_bytes": 0, "crc32": 0}
                    found.append(now)
                    out = store.open_output_stream(f"{base}/{now['path'].rpartition('/')[2]}", compression=None)
                raw = press.decompress(ids.as_buffer())
                out.write(raw)
                now["n_sequences"] += 1
                now["n_bytes"] += len(raw)
                now["crc32"] = zlib.crc32(raw, now["crc32"])
        if out is not None:
            out.close()
        if found:
            yield pa.RecordBatch.from_pylist(found)

    # Ranges of shards, so of slots: a task's number follows from the slot, and no sample is needed to find the bounds.
    dealt = numbered.mapInArrow(slots, "task int, shard long, slot long, ids binary").repartitionById(tasks, "task").sortWithinPartitions("slot")
    return dealt.select("shard", "slot", "ids").mapInArrow(write, "shard long, path string, first_slot long, n_sequences long, n_bytes long, crc32 long")


def read_shards(manifest: DataFrame, length: int = 1024, start: int = 0, stop: int | None = None, width: int = 2) -> DataFrame:
    """``slot, shard, byte_offset, ids`` of the slots from ``start`` on, each shard read from the first byte asked for, in order; ``width`` is an id's bytes."""
    stride = width * length
    rows = manifest.where(F.col("first_slot") + F.col("n_sequences") > start)
    if stop is not None:
        rows = rows.where(F.col("first_slot") < stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for shard, path, first, n in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            a, b = max(0, start - first), n if stop is None else min(n, stop - first)
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as stream:
                for i in range(a, b, 512):
                    m = min(512, b - i)
                    stream.seek(i * stride)
                    raw = stream.read(m * stride)
                    if len(raw) != m * stride:
                        raise ValueError(f"{path} ends before sequence {i + m}")
                    at = np.arange(i, i + m)
                    ids = [raw[k * stride : (k + 1) * stride] for k in range(m)]
                    yield pa.RecordBatch.from_arrays([pa.array(first + at), pa.array(np.full(m, shard)), pa.array(at * stride), pa.array(ids, pa.binary())], ["slot", "shard", "byte_offset", "ids"])

    cols = rows.select("shard", "path", "first_slot", "n_sequences").repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), "shard")
    return cols.mapInArrow(run, "slot long, shard long, byte_offset long, ids binary")


def materialised(docs: DataFrame, length: int = 1024, per_shard: int = 8192, key: int = 1) -> DataFrame:
    """Write all documents and read the shards back: ``slot, shard, byte_offset, number, ids_crc32`` per sequence; ``number`` by the inverse permutation."""
    with scratch(docs.sparkSession) as kept:
        manifest = write_shards(docs, new_folder(docs.sparkSession, "shards"), length, per_shard, key)
        count = manifest.agg(F.sum("n_sequences")).first()[0] or 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = permute(batch.column(0).to_numpy(), count, key, inverse=True)
                crc = [zlib.crc32(x.as_buffer()) for x in batch.column(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(number), pa.array(crc, pa.int64())], ["slot", "shard", "byte_offset", "number", "ids_crc32"])

        rows = read_shards(manifest, length, width=id_width(default_paths()))
        return kept(rows.mapInArrow(run, "slot long, shard long, byte_offset long, number long, ids_crc32 long"), "slots")
