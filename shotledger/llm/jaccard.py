"""N-gram Jaccard self-join by rare-first prefix filtering, and the classes of documents that its links join.

A document is the set of 64-bit hashes of its distinct five-word shingles. Documents with the same set are one *node*. Shingles have one
global order, rare ones first: by the exact number of nodes that have them, then by hash. Two nodes with Jaccard
similarity of at least t share a shingle among the first ``n - ceil(t n) + 1`` of each in that order. A shingle that only one node has joins nothing, so only
those of a prefix that another node has too are shuffled, which are few, as the rarest come first.

Counts come without moving shingles as rows: each group of documents sends sorted lists of shortened shingles, coded in a few bits each, and gets
the counts back in the same order (``shared_counts``). Nothing is broadcast for that, and no counter is shared between shingles at any size.

Only classes are asked for, so not all pairs of a group that shares a prefix shingle are made:

1. each node is compared with the first one, in order of size, under each of its prefix shingles;
2. the links found give components; where many nodes of more than one component share a shingle, each node outside the largest of them is
   compared with one of it picked by chance, again as long as that joins many;
3. all pairs of nodes that still lie in two components and share a prefix shingle are compared, in blocks of nodes.

Pairs must pass the length filter, the positional filter, and a suffix filter: the number of shingles that two sets can share is bounded by
the common bits of 2048-bit signatures of the shingles that others have too, plus those that fell on taken bits. What is left is made distinct and
verified once per pair by the whole hashes; a pair tried in one round isn't tried in another.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their own component; fewer than
five words give one shingle of all words; repeated rows are copies of each other; null ids don't name a component unless all its
ids are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.llm.memory import tidy
from shotledger.operators.components import components
from shotledger.sources.shared import broadcast_if_small, materialise, scratch

#: Bits of a signature; bytes of text in a group; shingles counted by one task at a time; nodes in a block of a crowded shingle.
BITS, GROUP_BYTES, RANGE_SHINGLES, BLOCK = 2048, 2 << 20, 2 << 20, 512
#: Most rounds by chance, and how many pairs a row may stand for before another round is worth it.
ROUNDS, PAIRS_PER_ROW = 8, 4

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in bytes that end with a space; upper-case A-Z count as lower case."""
    size = 1 << max(16, int(len(raw)).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _FACTOR, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[size]
    space = _IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    total = np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)])
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return starts, _mix((total[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))


def _pieces(raw: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """Cuts of about ``most`` bytes, each behind white space."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while end < len(raw):
            behind = np.flatnonzero(_IS_SPACE[raw[end : end + 65536]])
            if len(behind):
                end += int(behind[0]) + 1
                break
            end = min(len(raw), end + 65536)
        yield at, raw[at:end]
        at = end


def shingle_sets(texts: Sequence[str | bytes | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; with fewer words, of the whole sequence."""
    parts = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    found = [(at + s, h) for at, piece in _pieces(raw) for s, h in (_word_hashes(piece),)]
    starts, words = (np.concatenate(x) for x in zip(*found))
    cuts = np.searchsorted(starts, bounds)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _PLACES[k % 5] * np.uint64(2 * (k // 5) + 1)
    rolled = _mix(rolled)
    sets = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= width:
            own = rolled[a : b - width + 1].copy()
            own.sort()
            sets.append(own if len(own) < 2 else own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(keepdims=True)
            sets.append(_mix(short + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text; the text is the last column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths + 64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _print(own: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed numbers."""
    return tuple(int((_mix(own ^ np.uint64(k)).sum() + np.uint64(len(own))).view(np.int64)) for k in (0x51ED27, 0xA3C59AC3))


def _signature(own: np.ndarray) -> tuple[np.ndarray, int]:
    """A bit for each shingle, and how many shingles fell on taken bits."""
    bits = np.zeros(BITS, np.uint8)
    bits[(own >> np.uint64(32)) & np.uint64(BITS - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64), len(own) - int(bits.sum())


def packed(docs: DataFrame, width: int) -> DataFrame:
    """``grp, docs, texts``: documents in groups of about ``GROUP_BYTES`` of text, one row each, so that later passes meet the same documents together.

    ``docs`` has for each document its id, its number of shingles and 128 bits that equal sets share; ``texts`` is compressed. Of
    documents with one set that come up in one task only the first has its text there.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        seen: set[tuple[int, int]] = set()
        press = zstandard.ZstdCompressor(level=1)
        for part in _groups(batches, GROUP_BYTES):
            texts, rows, kept = [(t or "").encode() for t in part.column(1).to_pylist()], [], []
            for text, own in zip(texts, _sets_by_piece(texts, width)):
                node = _print(own) if len(own) else (0, 0)
                fresh = len(own) > 0 and node not in seen
                if fresh:
                    seen.add(node)
                kept.append(text if fresh else None)
                rows.append((len(own), *node))
            n, high, low = (pa.array(x, pa.int64()) for x in zip(*rows))
            struct = pa.StructArray.from_arrays([part.column(0), n, high, low], ["doc_id", "n", "high", "low"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), struct), pa.array([_pack(kept, press)], pa.binary())], ["grp", "docs", "texts"]
            )
            number += 1

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"grp long, docs array<struct<doc_id: {kind}, n: long, high: long, low: long>>, texts binary")


def _sets_by_piece(texts: list[bytes], width: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sets of many texts, hashed together about ``most`` bytes at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 64
        if size > most:
            yield from shingle_sets(held, width)
            held, size = [], 0
    if held:
        yield from shingle_sets(held, width)


def _pack(texts: list[bytes | None], press: zstandard.ZstdCompressor) -> bytes:
    lengths = np.array([-1 if t is None else len(t) for t in texts], "<i8")
    return press.compress(b"".join([np.int64(len(texts)).tobytes(), lengths.tobytes(), *(t for t in texts if t)]))


def _unpack(blob: pa.Buffer, places: list[int]) -> list[bytes]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    lengths = np.maximum(np.frombuffer(raw[8 : 8 + 8 * n], "<i8"), 0)
    stops = 8 + 8 * n + np.cumsum(lengths)
    return [bytes(raw[stops[k] - lengths[k] : stops[k]]) for k in places]


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in few bytes: byte planes, the upper ones of which are nearly empty, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _spread(blob: bytes | memoryview | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _owned(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, list[int], list[np.ndarray]]]:
    """Per group: its row but for texts, the places of the nodes whose text stands there, and their sets."""
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            row = {x: batch.column(i)[k] for i, x in enumerate(names)}
            places = sorted(row.pop("places").as_py())
            yield row, places, list(_sets_by_piece(_unpack(row.pop("texts").as_buffer(), places), width))


def shared_counts(groups: DataFrame, width: int, total: int) -> DataFrame:
    """``grp, answers``: for the distinct shingles of each group, in order and in ranges, how many other nodes of all groups have them.

    ``groups`` has ``grp, places, texts``, ``total`` is the number of shingles in all. Shingles are cut to 8 bits more than it takes to
    number them all, so that few meet by chance, which only makes a count too high. Each group sends its sorted list in
    ranges, a shingle once with its count; a range's task adds all groups' lists up and answers each group in the same order. A
    shingle that a third of all nodes have so comes once per group, and an answer about one that no other group has takes next to no room.
    """
    bits = min(60, max(16, int(total).bit_length() + 8))
    at_once = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = np.uint64(max(1, -(-total // RANGE_SHINGLES), min(at_once, total // (RANGE_SHINGLES // 32))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, sets in _owned(batches, width):
            values, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
            at, cuts = _ranges(values, bits, ranges)
            lists = [_squeeze(np.concatenate([values[a:b][:1], np.diff(values[a:b])])) for a, b in zip(cuts, cuts[1:])]
            own = [_squeeze(n[a:b] - 1) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array([row["grp"].as_py()] * len(at), pa.int64()), pa.array(lists, pa.binary()), pa.array(own, pa.binary())], ["range", "grp", "list", "own"])

    def add(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(_spread(x.as_buffer()), dtype=np.uint64) for x in table.column("list")]
        own = np.concatenate([_spread(x.as_buffer()) for x in table.column("own")]) + np.uint64(1)
        values, place = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.zeros(len(values), np.uint64)
        np.add.at(sums, place, own)
        cuts = np.cumsum([0, *map(len, lists)])
        answers = [_squeeze(sums[place[a:b]] - np.uint64(1)) for a, b in zip(cuts, cuts[1:])]
        return pa.table({"grp": table.column("grp"), "range": table.column("range"), "answer": pa.array(answers, pa.binary())})

    sent = groups.mapInArrow(tidy(send), "range long, grp long, list binary, own binary")
    answered = sent.groupBy("range").applyInArrow(add, "grp long, range long, answer binary")
    return answered.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("range", "answer"))).alias("answers"))


def _ranges(values: np.ndarray, bits: int, ranges: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The ranges in which there are values, and where each begins, for sorted values; then the end."""
    high = values >> np.uint64(max(0, bits - 36))
    at = (high * ranges) >> np.uint64(min(bits, 36))
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[starts], np.concatenate((starts, [len(values)]))


def posted(groups: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """The rarest shingles of each node, as many as the threshold asks for, of which only those that another node has too are rows.

    Rows ``token, node, n, pos`` have a shingle of a prefix; rows ``node, n, sig, slack, items`` have the set of a node with such a shingle, without
    the shingles that no other node has, which can be in no intersection.
    """
    bits = min(60, max(16, int(total).bit_length() + 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, places, sets in _owned(batches, width):
            values = np.unique(np.concatenate(sets) >> np.uint64(64 - bits))
            counts = _answers(row["answers"])
            if len(counts) != len(values):
                raise ValueError("answers don't fit the group's shingles")
            first = row["grp"].as_py() << 16
            tokens, owners, sizes, spots, full = [], [], [], [], []
            for place, own in zip(places, sets):
                others = counts[np.searchsorted(values, own >> np.uint64(64 - bits))]
                n = len(own)
                order = np.argsort(others, kind="stable")[: n - (percent * n + 99) // 100 + 1]
                pos = np.flatnonzero(others[order] > 0)
                if len(pos):
                    tokens.append(own[order[pos]].view(np.int64))
                    spots.append(pos)
                    owners.append(first + place)
                    sizes.append(n)
                    full.append(own[others > 0])
            if not tokens:
                continue
            each = np.array([len(t) for t in tokens])
            a, b = int(each.sum()), len(full)
            node, n = np.array(owners, np.int64), np.array(sizes, np.int64)
            sigs, slack = zip(*map(_signature, full))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(np.concatenate(tokens)), pa.nulls(b, pa.int64())]),
                    pa.array(np.concatenate([np.repeat(node, each), node])),
                    pa.array(np.concatenate([np.repeat(n, each), n])),
                    pa.concat_arrays([pa.array(np.concatenate(spots), pa.int64()), pa.nulls(b, pa.int64())]),
                    pa.array([None] * a + list(sigs), pa.list_(pa.int64())),
                    pa.array([None] * a + list(slack), pa.int64()),
                    pa.array([None] * a + [x.astype("<u8").tobytes() for x in full], pa.binary()),
                ],
                ["token", "node", "n", "pos", "sig", "slack", "items"],
            )

    return groups.mapInArrow(tidy(run), "token long, node long, n long, pos long, sig array<long>, slack long, items binary")


def _answers(found: pa.ListScalar) -> np.ndarray:
    """How many other nodes have each shingle, all ranges in a row."""
    return np.concatenate([_spread(x) for x in found.values.field("answer").to_pylist()])


def _fits(percent: int, n: Column, m: Column, i: Column, j: Column) -> Column:
    """Length and positional filter for sets of n and m shingles that share the i-th and j-th, each from 0, as their first."""
    most = F.least(n - i, m - j)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _may_share(percent: int, x: str, y: str, words: int = BITS // 64) -> Column:
    """Suffix filter: whether two sets can share enough, by their sizes ``n``, signatures ``sig`` and what fell on taken bits, ``slack``; ``x`` and ``y`` are put behind these names."""
    one, two = F.col(f"sig{x}"), F.col(f"sig{y}")
    common = sum((F.bit_count(F.get(one, F.lit(k)).bitwiseAND(F.get(two, F.lit(k)))) for k in range(words)), F.lit(0))
    most = common + F.least(F.col(f"slack{x}"), F.col(f"slack{y}"))
    return (100 + percent) * most >= percent * (F.col(f"n{x}") + F.col(f"n{y}"))


def _links(pairs: DataFrame, sets: DataFrame, tried: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs ``a, b`` that link, by their whole sets, and all that have been tried by now."""
    pairs = materialise(pairs.distinct(), "distinct")
    if tried is not None:
        pairs = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    ends = [sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sig", "slack")]) for x in "ab"]
    left = materialise(pairs.join(ends[0], "a").join(ends[1], "b").where(_may_share(percent, "_a", "_b")).select("a", "b"), "plausible")
    whole = [sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("items").alias(f"items_{x}")) for x in "ab"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(found, pa.bool_()))

    full = left.join(whole[1], "b").join(whole[0], "a").select("a", "b", "n_a", "n_b", "items_a", "items_b")
    links = materialise(full.mapInArrow(tidy(check), "a long, b long"), "links")
    return links, pairs if tried is None else tried.union(pairs)


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root`` after more links: the components of the roots that the links join."""
    if roots is None:
        return materialise(components(links), "roots")
    if links.isEmpty():
        return roots
    ends = links
    for x in "ab":
        ends = ends.join(roots.select(F.col("node").alias(x), "root"), x, "left").withColumn(x, F.coalesce("root", x)).drop("root")
    new = materialise(components(ends), "joined")
    old = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    # Nodes without links so far are their own root and stand in ``new`` alone.
    return materialise(old.union(new.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")


def _mixed(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows under shingles with nodes of several components, with their ``root``; the number of them, and of pairs to try among them.

    A node ``o`` with which all others under its shingle have been compared is left out there. ``k`` is the number of a shingle's rows, ``major`` the root of the most of them.
    """
    placed = rows.where("node <> o").select("token", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed, "placed")
    by_root = placed.groupBy("token", "root").agg(F.count("*").alias("c"))
    by_token = by_root.groupBy("token").agg(F.sum("c").alias("k"), F.count("*").alias("r"), F.max(F.struct("c", "root"))["root"].alias("major"), F.sum(F.col("c") * F.col("c")).alias("same"))
    by_token = materialise(by_token.where("r > 1"), "mixed_tokens")
    rows_left, pairs = by_token.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("same")) / 2)).first()
    return placed.join(broadcast_if_small(by_token.select("token", "k", "major")), "token"), rows_left or 0, pairs or 0


def _across(mixed: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """All pairs of nodes of two components that share a shingle and pass the filters.

    The nodes under a shingle are cut into blocks and each pair of blocks is a key of its own, so that no task holds a crowded shingle.
    """
    blocks = F.ceil(F.col("k") / block).cast("int")
    # Signatures of half the bits do here: pairs that pass meet the whole ones before they are verified.
    words = BITS // 64 // 2
    fold = F.zip_with(F.slice("sig", 1, words), F.slice("sig", 1 + words, words), lambda x, y: x.bitwiseOR(y))
    short = sets.select("node", (F.octet_length("items") / 8).cast("long").alias("s"), fold.alias("sig"))
    short = short.select("node", "sig", (F.col("s") - sum((F.bit_count(F.get("sig", F.lit(k))) for k in range(words)), F.lit(0))).alias("slack"))
    cut = mixed.join(short, "node").select("token", "node", "n", "pos", "root", "sig", "slack", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    a = cut.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1))).drop("blocks", "own")
    b = cut.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).drop("blocks", "own")
    b = b.withColumnsRenamed({c: f"{c}_" for c in ("node", "n", "pos", "root", "sig", "slack", "token", "i", "j")})
    same_key = (F.col("token") == F.col("token_")) & (F.col("i") == F.col("i_")) & (F.col("j") == F.col("j_"))
    good = (F.col("root") != F.col("root_")) & ((F.col("i") != F.col("j")) | (F.col("node") < F.col("node_"))) & _fits(percent, F.col("n"), F.col("n_"), F.col("pos"), F.col("pos_"))
    return a.join(b, same_key & good & _may_share(percent, "", "_", words)).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document; ``percent`` is the least Jaccard similarity of a link."""
    with scratch(docs.sparkSession) as kept:
        return kept(_classes(docs, width, percent), "classes")


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    groups = materialise(packed(docs.select("doc_id", F.col("text").cast("string").alias("text")), width), "groups")
    summary = groups.select("grp", F.posexplode("docs").alias("place", "d")).select("grp", "place", "d.*")
    own = F.min(F.col("grp") * 65536 + F.col("place"))
    nodes = materialise(summary.where("n > 0").groupBy("high", "low").agg(own.alias("node"), F.first("n").alias("n"), F.min("doc_id").alias("least")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0

    places = nodes.groupBy(F.shiftright("node", 16).alias("grp")).agg(F.collect_list(F.col("node").bitwiseAND(F.lit(65535)).cast("int")).alias("places"))
    owned = groups.select("grp", "texts").join(places, "grp")
    answers = shared_counts(owned.select("grp", "places", "texts"), width, total)
    rows = materialise(posted(owned.join(answers, "grp").select("grp", "places", "texts", "answers"), width, percent, total), "posted")
    sets = rows.where("token is null").select("node", "n", "sig", "slack", "items")
    rows = rows.where("token is not null").select("token", "node", "n", "pos")

    # The first node under a shingle is that of the least size; of one size two orders are used, so that not all have the same one first.
    at = F.struct("n", F.xxhash64("node", F.col("token").bitwiseAND(F.lit(1))).alias("h"), "node", "pos")
    by_token = rows.groupBy("token").agg(F.count("*").alias("k"), F.min(at).alias("first")).where("k > 1")
    by_token = materialise(by_token.select("token", F.col("first.node").alias("o"), F.col("first.n").alias("o_n"), F.col("first.pos").alias("o_pos")), "firsts")
    rows = materialise(rows.join(broadcast_if_small(by_token), "token"), "shared")

    def pairs(rows: DataFrame) -> DataFrame:
        good = (F.col("node") != F.col("o")) & _fits(percent, F.col("n"), F.col("o_n"), F.col("pos"), F.col("o_pos"))
        return rows.where(good).select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))

    links, tried = _links(pairs(rows), sets, None, percent)
    roots = _joined(None, links)
    mixed, n_rows, n_pairs = _mixed(rows, roots)
    for r in range(ROUNDS):
        if n_pairs <= PAIRS_PER_ROW * n_rows:
            break
        by_chance = F.struct(F.xxhash64("node", F.col("token").bitwiseAND(F.lit(7)), F.lit(r)).alias("h"), "node", "n", "pos")
        some = mixed.where("root = major").groupBy("token").agg(F.min(by_chance).alias("s")).select("token", F.col("s.node").alias("o"), F.col("s.n").alias("o_n"), F.col("s.pos").alias("o_pos"))
        mixed = mixed.join(broadcast_if_small(materialise(some, "some")), "token")
        links, tried = _links(pairs(mixed.where("root != major")), sets, tried, percent)
        roots = _joined(roots, links)
        before = n_pairs
        mixed, n_rows, n_pairs = _mixed(mixed, roots)
        if n_pairs > 0.8 * before:  # more rounds gain little; what follows is exact in any case
            break
    if n_pairs:
        links, tried = _links(_across(mixed, sets, percent), sets, tried, percent)
        roots = _joined(roots, links)

    named = nodes.join(roots, "node", "left").select("high", "low", "least", F.coalesce("root", "node").alias("class"))
    named = materialise(named, "named")
    lowest = named.groupBy("class").agg(F.min("least").alias("lowest"))
    by_set = named.join(lowest, "class").select("high", "low", "lowest")
    return summary.join(by_set, ["high", "low"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_per_class(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class; equal rows of one id and text are one.

    Rows with one id but texts of which neither is the other's copy are told apart by nothing and stay together.
    """
    found = classes(docs, width, percent)
    kept = materialise(found.where("doc_id <=> component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    own = unused(docs, "kept_id")
    rows = docs.join(broadcast_if_small(kept.select(F.col("doc_id").alias(own))), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    # Ids are unique as a rule; only otherwise are texts shuffled for this.
    return rows if kept.where("n > 1").isEmpty() else rows.dropDuplicates(["doc_id", "text"])


def oracle_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') || chr(10) FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT r.s, e.b FROM r JOIN e ON r.t = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""
