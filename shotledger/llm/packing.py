"""Bound-certified repacking of document pieces into sequences.

Pieces are dealt out by hash over partitions of about ``per_partition`` pieces. Each partition packs by best-fit decreasing and computes a
lower bound on its sequences: the largest that a family of dual feasible functions proves (plain volume, and for each threshold the
function that rounds items over ``size - t`` up to a whole sequence and drops those under ``t``; and the functions that round sizes
to k-ths). A partition whose count equals its bound is certified and done. The others exchange documents: pieces of their
sequences that aren't full form a pool, which is dealt out anew and packed again, each time in larger shares of what is left, as
long as the pool as a whole needs fewer sequences than before. What a piece's partition needed and what its bound proves is put out with it, so
that a partition without a certificate can be seen.

Defined results: an empty input gives no rows; repeated rows are packed each; a null id is an id like any other. Pieces that fill a
sequence alone aren't moved at all. No partition holds more than a multiple of ``per_partition`` pieces, whatever the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.llm.tokens import pieces
from shotledger.sources.shared import materialise, scratch

PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, longest first into the fullest sequence with room, and the number of sequences."""
    order = np.argsort(-lengths, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask, count = 0, 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, own = size, count
            count += 1
        bins[i], offsets[i] = own, size - room
        room -= n
        if room:
            rooms[room].append(own)
            mask |= 1 << room
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that any packing needs, by the best of the dual feasible functions tried."""
    counts = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    sizes = np.arange(size + 1)
    best = -(-int((counts * sizes).sum()) // size)
    total, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    for t in range(1, size // 2 + 1):
        large = int(total[size] - total[size - t])
        middle = int(volume[size - t] - volume[t - 1])
        best = max(best, large + -(-middle // size))
    for k in range(1, 100):
        whole = (k + 1) * sizes % size == 0
        # k-ths of a sequence: sizes that are whole multiples of 1 / (k + 1) keep their share, others round down to k-ths.
        share = np.where(whole, sizes * k, (k + 1) * sizes // size * size)
        best = max(best, -(-int((counts * share).sum()) // (k * size)))
    return best


def _packed(rows: DataFrame, part: Column, size: int) -> DataFrame:
    """Each partition's pieces packed: ``part, bin, offset`` and the partition's ``bins`` and ``bound`` beside the piece."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        # The order of rows that a shuffle leaves isn't fixed; equal pieces may change places, lengths may not.
        bins, offsets, count = best_fit(lengths, size)
        fill = np.bincount(bins, lengths, minlength=count).astype(np.int64)
        n = table.num_rows
        extra = {"bin": bins, "offset": offsets, "fill": fill[bins], "bins": np.full(n, count), "bound": np.full(n, lower_bound(lengths, size))}
        for name, values in extra.items():
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in PIECE), "row long", "part long", *(f"{c} long" for c in ("bin", "offset", "fill", "bins", "bound"))])
    return rows.select(*PIECE, "row", part.cast("long").alias("part")).groupBy("part").applyInArrow(run, schema)


def pack_pieces(rows: DataFrame, size: int = 1024, per_partition: int = 32768) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for pieces of at most ``size`` ids; and ``part_sequences, part_bound`` of the partition that placed it."""
    full = rows.where(F.col("length") == size)
    # Numbered, so that equal pieces are dealt out like any others.
    pool = materialise(rows.where(F.col("length") < size).select(*PIECE, F.monotonically_increasing_id().alias("row")), "pool")
    done: list[DataFrame] = []
    before, waiting, r = None, None, 0
    while count := pool.count():
        parts = max(1, math.ceil(count / (per_partition << min(r, 2))))
        part = F.pmod(F.xxhash64(F.lit(r), "row"), F.lit(parts))
        packed = materialise(_packed(pool, part, size), f"packed{r}")
        by_part = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        now = by_part.agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound")).first()
        if before is not None and now["bins"] >= before:
            done.append(waiting)  # the exchange gained nothing: what was packed before stays
            break
        placed = packed.select(*PIECE, "row", (F.lit(r) * (1 << 48) + F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset", F.col("bins").alias("part_sequences"), F.col("bound").alias("part_bound"), "fill")
        is_open = (F.col("part_sequences") > F.col("part_bound")) & (F.col("fill") < size)
        done.append(placed.where(~is_open).drop("fill"))
        waiting = placed.where(is_open).drop("fill")
        before = waiting.select("sequence_id").distinct().count()
        pool = waiting.select(*PIECE, "row")
        r += 1
    # A piece that fills its sequence gets a number of its own below zero.
    one = F.lit(1).cast("long")
    out = full.select(*PIECE, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("part_sequences"), one.alias("part_bound"))
    for part in done:
        out = out.union(part.drop("row"))
    return out


def pack(docs: DataFrame, size: int = 1024, **options: int) -> DataFrame:
    """``pack_pieces`` for the pieces of all ``docs``."""
    with scratch(docs.sparkSession) as kept:
        return kept(pack_pieces(materialise(pieces(docs, size), "pieces"), size, **options), "packed")
