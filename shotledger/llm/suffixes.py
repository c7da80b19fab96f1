"""Repeated substrings over all documents: enhanced suffix arrays over anchored windows, scanned for maximal repeats.

A string of ``length`` bytes that occurs twice has the same *anchor* in both places: the ``GRAM``-byte piece in it with the least hash.
So each start in a document is dealt out by its anchor, and starts in a row with one anchor make one *window*: the bytes from
the first of them to the end of the last one's string. Equal strings always meet under one anchor, whatever the partitions are.

1. Windows that are equal (by the 64-bit hash of the anchor, place of the anchor, length, and 96 more bits of hashes of the bytes) form a class; all but
   the earliest of a class are repeats as a whole, and no bytes of theirs are moved.
2. Where an anchor has several classes, their earliest windows are fetched. If more than ``GROUP_WINDOWS`` meet under one anchor, they are divided: a
   string that starts some bytes before the anchor holds the bytes around it that all strings starting in the same half of that range hold, so
   each half of a window's starts becomes a window under the longer piece, and equal strings still meet. Equal windows are one class
   again, now compared byte for byte; what is still crowded is halved again, at most down to single strings. So no task holds a crowded anchor.
3. Each task sorts all suffixes of its windows into an enhanced suffix array (prefix doubling; common-prefix lengths from the doubling
   ranks) and scans it with a stack for the common-prefix intervals of at least ``length`` bytes. An interval is a maximal
   repeat if its suffixes follow differing bytes, or begin a window (what stands before lies under another anchor); it is put out with all its
   occurrences. ``repeat_groups`` gives these as rows. Within them a repeat longer than a window is as many groups as it has windows.

In a repeat, every occurrence but the earliest (by document id, then place) covers bytes that are removed; bytes that a string with an
earlier occurrence covers are covered by such a repeat, and the other way round.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; rows with equal id and text are one document and get the
same result; rows with one id and differing texts are documents of their own, ordered by the SHA-256 of their texts; a null id comes before all others; extra
columns are ignored. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotledger.llm.jaccard import _FACTOR, _INVERSE, _mix
from shotledger.llm.memory import tidy
from shotledger.sources.shared import BROADCAST_BYTES, broadcast_if_small, materialise, scratch, size_in_bytes

GRAM, PIECE, GROUP_WINDOWS, BATCH_BYTES, TASK_WINDOWS, TASK_ROWS = 36, 1 << 19, 512, 1 << 20, 1 << 15, 1 << 19
#: A window's ``size`` column: its size in 12 bits, then how far the anchor stands behind its start, then more bits of a hash.
SIZE_BITS, OFFSET_BITS, CHECK_BITS = 12, 12, 32
_POS = np.uint64((1 << 20) - 1)
_UP = _DOWN = np.ones(1, np.uint64)
#: Other numbers for the bytes, so that a second hash of the same form doesn't agree where the first one does by chance.
_OTHER = _mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27))


def _range_hashes(raw: np.ndarray):
    """A function of start and end that hashes the bytes between."""
    global _UP, _DOWN
    if len(_UP) <= len(raw):
        size = 1 << (int(len(raw)).bit_length() + 1)
        _UP, _DOWN = np.full(size, _FACTOR, np.uint64), np.full(size, _INVERSE, np.uint64)
        _UP[0] = _DOWN[0] = 1
        _UP, _DOWN = np.cumprod(_UP), np.cumprod(_DOWN)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64, copy=False) + np.uint64(1)) * _UP[: len(raw)], out=total[1:])
    return lambda a, b: _mix((total[b] - total[a]) * _DOWN[a])


def windows(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For documents ``raw[bounds[d]:bounds[d + 1]]``, under 2**20 bytes in all: document, first start, size, anchor hash, class hash, place of the anchor and a second class hash of each window."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64, np.uint64))
    n, reach = len(raw), length - GRAM + 1
    if n < length:
        return none
    hashes = _range_hashes(raw)
    at = np.arange(n - GRAM + 1)
    gram = hashes(at, at + GRAM)
    least = (gram & ~_POS) | at.astype(np.uint64)
    span = 1
    while span < reach:  # least of the ``reach`` pieces from each start, by doubling
        step = min(span, reach - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    ok = np.zeros(len(least) + 1, bool)
    ends = np.maximum(bounds[1:] - length + 1, bounds[:-1])
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, bounds[:-1], 1)
    np.add.at(mark, ends, -1)
    ok[:-1] = np.cumsum(mark)[: len(least)] > 0
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = least[1:] != least[:-1]
    first = np.flatnonzero(ok[:-1] & (change[:-1] | ~np.concatenate(([False], ok[:-2]))))
    if not len(first):
        return none
    stops = np.flatnonzero(ok[:-1] & (change[1:] | ~ok[1:])) + 1
    # A document may begin right where another ends.
    size = stops - first - 1 + length
    anchor = (least[first] & _POS).astype(np.int64)
    doc = np.searchsorted(bounds, first, side="right") - 1
    kind = _mix(hashes(first, first + size) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (anchor - first).astype(np.uint64))
    check = _mix(_range_hashes(_OTHER[raw])(first, first + size)) >> np.uint64(64 - CHECK_BITS)
    return doc, first - bounds[doc], size, gram[anchor], kind, anchor - first, check


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``number``, which orders documents and tells them apart: the id, or where ids repeat or are null the place of (id, hash of the text) among all."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs.withColumn("number", F.col("doc_id"))
    docs = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    line = docs.select("doc_id", "digest").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    line = materialise(line.select(F.col("doc_id").alias("number_of"), F.col("digest").alias("digest_of"), F.monotonically_increasing_id().alias("number")), "numbers", -2)
    both = F.col("doc_id").eqNullSafe(F.col("number_of")) & (F.col("digest") == F.col("digest_of"))
    return docs.join(broadcast_if_small(line), both).drop("number_of", "digest_of", "digest")


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """``anchor, kind, doc_id, at, size`` of windows; ``at`` is the place in the text, and ``size`` is packed.

    Of equal windows that come up together in a task only the earliest is a row; the others are repeats already, and rows
    without ``kind`` give the spans that they cover, with their plain size.
    """
    if 2 * length >= 1 << SIZE_BITS:
        raise ValueError(f"length must be under {1 << SIZE_BITS - 1}")

    def flush(ids: list, offsets: list, found: list[tuple[np.ndarray, ...]], id_type: pa.DataType) -> pa.RecordBatch:
        doc, start, size, anchor, kind, offset, check = (np.concatenate(x) for x in zip(*found))
        at = np.array(offsets, np.int64)[doc] + start
        known = {x: k for k, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x)))}
        age = np.array([known[x] for x in ids])[doc]
        packed = size + (offset << SIZE_BITS) + (check.astype(np.int64) << (SIZE_BITS + OFFSET_BITS))
        order = np.lexsort((at, age, packed, kind, anchor))
        same = lambda x: x[order[1:]] == x[order[:-1]]
        head = np.concatenate(([True], ~(same(anchor) & same(kind) & same(packed))))
        start_of = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        keep = order[head | ((at[order] == at[start_of]) & (age[order] == age[start_of]))]
        rest = np.setdiff1d(order, keep)
        rest = rest[np.lexsort((at[rest], doc[rest]))]
        # Windows of one document that touch make one span.
        cut = np.ones(len(rest), bool)
        cut[1:] = (doc[rest[1:]] != doc[rest[:-1]]) | (at[rest[1:]] > at[rest[:-1]] + size[rest[:-1]])
        first, last = rest[cut], rest[np.concatenate((np.flatnonzero(cut)[1:] - 1, [len(rest) - 1]))] if len(rest) else rest
        whole = at[last] + size[last] - at[first]
        columns = [
            pa.array(np.concatenate([anchor[keep], _mix(at[first].astype(np.uint64) + age[first].astype(np.uint64))]).view(np.int64)),
            pa.array(np.concatenate([kind[keep].view(np.int64), np.zeros(len(first), np.int64)]), mask=np.arange(len(keep) + len(first)) >= len(keep)),
            pa.array(ids, id_type).take(pa.array(np.concatenate([doc[keep], doc[first]]))),
            pa.array(np.concatenate([at[keep], at[first]])),
            pa.array(np.concatenate([packed[keep], whole])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "kind", "doc_id", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets, found = [], [], []
        parts: list[bytes] = []
        rows = held = 0
        id_type = None

        def search() -> None:
            nonlocal rows, held
            if parts:
                raw = np.frombuffer(b"".join(parts), np.uint8)
                doc, *rest = windows(raw, np.cumsum([0, *map(len, parts)]), length)
                found.append((doc + (len(ids) - len(parts)), *rest))
                rows += len(doc)
                parts.clear()
                held = 0

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode()
                for a in range(0, max(1, len(text) - length + 1), PIECE):
                    part = text[a : a + PIECE + length - 1]
                    if len(part) < length:
                        continue
                    if held + len(part) > PIECE:
                        search()
                        if rows > TASK_ROWS:
                            yield flush(ids, offsets, found, id_type)
                            ids, offsets, found, rows = [], [], [], 0
                    for x, y in ((ids, key), (offsets, a), (parts, part)):
                        x.append(y)
                    held += len(part)
        search()
        if rows:
            yield flush(ids, offsets, found, id_type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"anchor long, kind long, doc_id {kind}, at long, size long")


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols or more, and with each the length it shares with the one before (up to that depth).

    Symbols are numbers under 512.
    """
    n = len(symbols)
    span = 7
    padded = np.concatenate([symbols, np.zeros(span, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(span):
        key = (key << np.uint64(9)) | padded[k : k + n]
    ranks = []
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.zeros(n, np.int32)
        rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        ranks.append((span, rank))
        if span >= depth or rank[order[-1]] == n - 1:
            break
        behind = np.zeros(n, np.int32)
        behind[: max(0, n - span)] = rank[span:] + 1
        key = (rank.astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        span *= 2
    common = np.zeros(n, np.int64)
    x, y = order[1:].copy(), order[:-1].copy()
    for span, rank in reversed(ranks):
        same = (x < n) & (y < n)
        same[same] = rank[x[same]] == rank[y[same]]
        common[1:][same] += span
        x[same] += span
        y[same] += span
    for _ in range(6):  # what is left is under seven symbols
        same = (x < n) & (y < n)
        same[same] = symbols[x[same]] == symbols[y[same]]
        common[1:][same] += 1
        x, y = np.where(same, x + 1, n), np.where(same, y + 1, n)
    return order, common


def maximal_repeats(parts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, part numbers, places) of every maximal repeat of at least ``length`` bytes among windows, with all its occurrences."""
    # An end mark below all bytes stands behind each window: what ends there comes before all that goes on.
    symbols = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
    each = np.array([len(p) for p in parts])
    ends = np.cumsum(each + 1) - 1
    starts = ends - each
    symbols[ends] = 0
    part = np.repeat(np.arange(len(parts)), each + 1)
    order, common = suffix_array(symbols, max(128, int(each.max())))
    room = ends[part] - np.arange(len(symbols))
    use = room[order] >= length
    # Between suffixes that are used, the common length is the least of those passed over.
    keep = np.flatnonzero(use)
    if len(keep) < 2:
        return
    shared = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
    sa = order[keep]
    shared[1:] = np.minimum(shared[1:], np.minimum(room[sa[1:]], room[sa[:-1]]))
    shared[0] = 0
    left = np.where(sa == starts[part[sa]], 256, symbols[sa - 1].astype(np.int64) - 1)
    linked = shared >= length
    heads = np.flatnonzero(~linked)
    tails = np.concatenate((heads[1:], [len(sa)]))
    many = tails - heads > 1
    heads, tails = heads[many], tails[many]
    if not len(heads):
        return
    # Runs whose suffixes all follow one and the same byte hold no maximal repeat; the scan passes them by.
    differs = np.zeros(len(sa), np.int64)
    differs[1:] = (left[1:] != left[:-1]) | (left[1:] == 256)
    total = np.cumsum(differs)
    diverse = (total[tails - 1] - total[heads] > 0) | (left[heads] == 256)
    for a, b in zip(heads[diverse].tolist(), tails[diverse].tolist()):
        lcp, lefts = shared[a:b].tolist(), left[a:b].tolist()
        stack: list[list] = []  # [size, first suffix, left byte of all so far or -1 if they differ]
        for i in range(1, b - a + 1):
            now = lcp[i] if i < b - a else 0
            begin, seen = i - 1, lefts[i - 1] if lefts[i - 1] != 256 else -1
            while stack and stack[-1][0] > now:
                size, begin, own = stack.pop()
                seen = own if own == seen else -1
                if seen == -1:
                    places = sa[a + begin : a + i]
                    yield size, part[places], places - starts[part[places]]
            if now >= length:
                if stack and stack[-1][0] == now:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else -1
                else:
                    stack.append([now, begin, seen])


def _divided(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Windows cut so that each has starts from one range of ``width`` places before the anchor, under the hash of what all strings starting there share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                out: list[tuple] = []
                for k, (anchor, at, offset, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in ("anchor", "at", "offset", "bytes")))):
                    last = offset - (len(raw) - length)
                    for block in range(last // width, offset // width + 1):
                        low, high = block * width, block * width + width - 1
                        a, b = min(offset, high), max(last, low)
                        common = raw[max(0, offset - low) : offset - high + length]
                        key = hashlib.blake2b(common, digest_size=8, key=f"{anchor} {low}".encode()).digest()
                        out.append((int.from_bytes(key, "little", signed=True), k, at + offset - a, a, raw[offset - a : offset - b + length]))
                anchor, k, at, offset, raw = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor, pa.int64()), part.column("doc_id").take(pa.array(k)), pa.array(at, pa.int64()), pa.array(offset, pa.int32()), pa.array(raw, pa.binary())], ["anchor", "doc_id", "at", "offset", "bytes"]
                )

    return rows.mapInArrow(tidy(run), f"anchor long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, at long, offset int, bytes binary")


def _windows(docs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """``anchor, doc_id, at, bytes`` of distinct windows to be compared, at most ``GROUP_WINDOWS`` under an anchor; and spans ``doc_id, at, size`` that equal windows cover outside their earliest one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    group = Window.partitionBy("anchor")
    order = group.orderBy("kind", "size", F.col("doc_id").asc_nulls_first(), "at")
    place, same_class = F.struct("doc_id", "at"), F.struct("kind", "size")
    met = (
        _anchored(docs, length)
        .withColumns({"prev": F.lag(same_class).over(order), "next": F.lead(same_class).over(order), "first": F.first(place).over(Window.partitionBy("anchor", "kind", "size").orderBy(F.col("doc_id").asc_nulls_first(), "at"))})
        .where("kind is null or prev is not null or next is not null")
        .withColumn("is_head", F.col("kind").isNotNull() & (F.col("prev").isNull() | (F.col("prev") != same_class)))
    )
    met = materialise(met.drop("prev", "next"), "met")
    size = F.col("size").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    covered = [met.where(F.col("kind").isNull() | (F.col("first") != place)).select("doc_id", "at", F.when(F.col("kind").isNull(), F.col("size")).otherwise(size).alias("size"))]

    heads = met.where("is_head")
    rivals = heads.groupBy("anchor").agg(F.count("*").alias("rivals")).where("rivals > 1")
    offset = F.shiftright("size", SIZE_BITS).bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)).cast("int")
    wanted = heads.join(rivals, "anchor").select("doc_id", "at", size.cast("int").alias("size"), "anchor", offset.alias("offset"), (F.col("rivals") > GROUP_WINDOWS).alias("crowded"))
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "size", "anchor", "offset", "crowded")).alias("wanted"))
    lists = materialise(lists.withColumnRenamed("doc_id", "wanted_id"), "wanted")
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    near = docs.join(broadcast_if_small(lists.select("wanted_id")), same, "left_semi")
    cut = near.join(lists, same).select("doc_id", "text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["anchor", "doc_id", "at", "offset", "bytes", "crowded"], (pa.int64(), None, pa.int64(), pa.int32(), pa.binary(), pa.bool_())
        for batch in batches:
            rows: list[tuple] = []
            for k, (key, text, wanted) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                text = (text or "").encode()
                rows += [(w["anchor"], key, w["at"], w["offset"], text[w["at"] : w["at"] + w["size"]], w["crowded"]) for w in wanted]
                if len(rows) > 20000 or rows and k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.column(0).type) for c, t in zip(zip(*rows), types)], names)
                    rows = []

    fetched = materialise(cut.mapInArrow(tidy(fetch), f"anchor long, doc_id {kind}, at long, offset int, bytes binary, crowded boolean"), "windows")
    cols = ["anchor", "doc_id", "at", "offset", "bytes"]
    ready = fetched.where("not crowded").select(*cols)
    crowded = fetched.where("crowded").select(*cols)
    width = 1 << (length - GRAM).bit_length()
    while width > 1 and not crowded.isEmpty():
        width //= 2
        parts = materialise(_divided(crowded, length, width), "parts")
        by_class = parts.groupBy("anchor", "bytes").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "at")).alias("first"), F.min("offset").alias("offset"), F.count("*").alias("n"))
        by_class = materialise(by_class, "parts_by_class")
        covered.append(
            parts.join(by_class.where("n > 1").select("anchor", "bytes", "first"), ["anchor", "bytes"])
            .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
            .select("doc_id", "at", F.octet_length("bytes").cast("long").alias("size"))
        )
        per_key = by_class.groupBy("anchor").agg(F.count("*").alias("rivals")).where("rivals > 1")
        heads = by_class.join(per_key, "anchor").select("anchor", F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("at"), "offset", "bytes", "rivals")
        heads = materialise(heads, "divided")
        ready = ready.union(heads.where(F.col("rivals") <= GROUP_WINDOWS).select(*cols))
        crowded = heads.where(F.col("rivals") > GROUP_WINDOWS).select(*cols)
    return ready.select("anchor", "doc_id", "at", "bytes"), covered


def _scanned(windows: DataFrame, length: int, groups: bool) -> DataFrame:
    """Suffix arrays of all anchors' windows: spans ``doc_id, at, size`` outside each repeat's earliest occurrence; or with ``groups`` every occurrence ``grp, size, doc_id, at``."""
    kind = windows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "size", "doc_id", "at"] if groups else ["doc_id", "at", "size"]

        def found(rows: list[tuple]) -> pa.RecordBatch:
            parts = [r[3] for r in rows]
            ids, at = [r[1] for r in rows], [r[2] for r in rows]
            covered: dict[int, list[tuple[int, int]]] = {}
            out: list[tuple] = []
            for size, part, places in maximal_repeats(parts, length):
                spots = [(ids[p] is not None, ids[p], at[p] + q, p) for p, q in zip(part.tolist(), places.tolist())]
                first = min(spots)[:3]
                if groups:
                    string = parts[part[0]][places[0] : places[0] + size]
                    name = hashlib.blake2b(string, digest_size=16, key=str(rows[part[0]][0]).encode()).hexdigest()
                    out += [(name, size, ids[p], a) for _, _, a, p in spots]
                else:
                    for _, _, a, p in (x for x in spots if x[:3] != first):
                        covered.setdefault(p, []).append((a, a + size))
            types = (pa.string(), pa.int64(), id_type, pa.int64()) if groups else (id_type, pa.int64(), pa.int64())
            if not groups:
                out = [(ids[p], a, b - a) for p, spans in covered.items() for a, b in merged(spans)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

        held: list[tuple] = []
        size, id_type = 0, None
        for batch in batches:
            id_type = batch.column(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BATCH_BYTES and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield found(held)

    # Sorting suffixes is work out of proportion to the bytes moved, so partitions aren't left to be merged by size.
    parts = max(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-windows.count() // TASK_WINDOWS))
    dealt = windows.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(tidy(scan), f"grp string, size long, doc_id {kind}, at long" if groups else f"doc_id {kind}, at long, size long")


def _placed(rows: DataFrame) -> DataFrame:
    """``doc_id, start, stop`` of spans ``doc_id, at, size``."""
    return rows.select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"))


def repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Spans ``doc_id, start, stop`` in bytes, overlaps and all, that repeats cover outside their earliest occurrence; ``doc_id`` tells texts apart, as ``numbered`` makes it."""
    windows, covered = _windows(docs.select("doc_id", F.col("text").cast("string").alias("text")), length)
    found = _placed(_scanned(windows, length, False))
    for part in covered:
        found = found.union(_placed(part))
    return found


def repeat_groups(docs: DataFrame, length: int = 100) -> DataFrame:
    """``grp, size, number, start``: every maximal repeat among the distinct windows, one row per occurrence; equal windows stand for each other once. ``number`` is that of ``numbered``."""
    with scratch(docs.sparkSession) as kept:
        rows = numbered(docs.select("doc_id", F.col("text").cast("string").alias("text")))
        windows, _ = _windows(rows.select(F.col("number").alias("doc_id"), "text"), length)
        return kept(_scanned(windows, length, True).select("grp", "size", F.col("doc_id").alias("number"), F.col("at").alias("start")), "groups")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, length: int = 100, keep: Sequence[str] = ()) -> DataFrame:
    """Per document ``doc_id, text, spans, left, left_text``: its text as bytes, the maximal spans removed, the bytes left, and the characters whole among them.

    Columns in ``keep`` come along in the struct ``rest``.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), rest.alias("rest"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    with scratch(docs.sparkSession) as kept:
        docs = numbered(docs)
        found = repeats(docs.select(F.col("number").alias("doc_id"), "text"), length).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
        spans = kept(found.withColumnRenamed("doc_id", "span_id"), "spans")
    same = F.col("number") == F.col("span_id")
    if size_in_bytes(spans.select("span_id")) <= BROADCAST_BYTES:
        ids = F.broadcast(spans.select("span_id"))
        hit = docs.join(ids, same, "left_semi").join(spans, same).select("doc_id", "text", "rest", "spans")
        rest = docs.join(ids, same, "left_anti").select("doc_id", "text", "rest", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
        both = hit.union(rest)
    else:
        both = docs.join(spans, same, "left").select("doc_id", "text", "rest", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts, cuts, left = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(3).to_pylist()):
                    text = (text or "").encode()
                    own = merged([(s["start"], s["stop"]) for s in found or ()])
                    edges = [0, *(x for s in own for x in s), len(text)]
                    texts.append(text)
                    cuts.append([{"start": a, "stop": b} for a, b in own])
                    left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.binary()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(left, pa.binary()), pa.array([x.decode(errors="ignore") for x in left], pa.string()), part.column(2)],
                    ["doc_id", "text", "spans", "left", "left_text", "rest"],
                )

    return both.mapInArrow(tidy(run), f"doc_id {kinds['doc_id']}, text binary, spans array<struct<start: long, stop: long>>, left binary, left_text string, rest {kinds['rest']}")


def cleaned(docs: DataFrame, length: int = 100) -> DataFrame:
    """All rows of ``documents`` without the repeats; characters that a removal cut in two go, and ``n_chars`` is counted anew.

    A document of which nothing is left stays, with an empty text.
    """
    names = docs.columns
    keep = [c for c in names if c not in ("doc_id", "text", "n_chars")]
    left = without_repeats(docs, length, keep)
    made = {"doc_id": F.col("doc_id"), "text": F.col("left_text"), "n_chars": F.char_length("left_text").cast("long")}
    return left.select(*[(made[c] if c in made else F.col(f"rest.`{c}`")).alias(c) for c in names])


def digest(cleaned: DataFrame) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return cleaned.select(
        "doc_id", n.alias("n_bytes"), (n - F.octet_length("left")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("left", 256).alias("kept_sha256")
    )


def oracle_sql(length: int = 100) -> str:
    """Every string of ``length`` bytes with its first occurrence, as SQL; bytes stand as two hex digits."""
    return f"""
WITH d0 AS (SELECT doc_id, coalesce(text, '') AS text, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r FROM documents),
d AS (SELECT DISTINCT r, hex(encode(text)) AS h FROM d0),
g AS (SELECT r, i, md5(substr(h, 2 * i + 1, {2 * length})) AS s FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {length - 1})) AS i FROM d WHERE length(h) >= {2 * length})),
o AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM g) WHERE k > 1),
n AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {length}, true) AS new FROM o),
m AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM n),
s AS (SELECT r, min(i) AS a, max(i) + {length} AS b FROM m GROUP BY r, span),
e AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS since, row_number() OVER (PARTITION BY r ORDER BY a DESC) AS k FROM s),
k AS (SELECT e.r, sum(b - a) AS removed, count(*) AS spans,
             string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || max(CASE WHEN k = 1 THEN substr(h, 2 * b + 1) ELSE '' END) AS kept
      FROM e JOIN d USING (r) GROUP BY e.r)
SELECT d0.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d0 JOIN d USING (r) LEFT JOIN k USING (r)"""
