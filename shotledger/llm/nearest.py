"""Nearest neighbours by inverted lists and an adaptive scan over the dimensions of rotated vectors.

1. An index is fitted on a bounded sample (``sample`` vectors of each dimension, by hash of their bytes): a random rotation and a codebook of centroids for each
   half of the rotated dimensions. A list is a pair of centroids, so that ``codes ** 2`` lists come from ``codes`` centroids a half, and the number
   of lists can follow the root of the table's size. Every vector is in the list nearest to it.
2. Each query scans the lists on its own shelf (neighbouring lists of about ``MEMBERS`` vectors). The greatest of the distances found bounds the answer.
3. With that bound it asks the other lists that can hold something nearer: by their least and greatest distances from their centroid, and by the plane between their
   centroid and the query's own. A neighbour's difference spreads over all dimensions that vectors use, so along one direction it is the distance divided by these dimensions'
   root, give or take; ``certainty`` is how many times that is allowed for (None allows for the whole distance and misses no list).
4. Within a list the rotated vectors are read in blocks of ``WIDTH`` columns. After each block, a candidate's squared partial distance is compared with the squared bound: of a
   vector turned at random, ``s`` of ``d`` dimensions hold the share ``s / d`` of the square, with variance ``2 s (d - s) / (d^2 (d + 2))``. A candidate whose share of
   the bound is more than ``deviations`` standard deviations above that is given up. What is left after all dimensions is measured on the original vectors in double precision.

Work is cut into blocks of members and of queries, so that a crowded list is many tasks, and each block returns no more than the ``k + 1`` nearest it has for a query. Equal vectors are one
member with its ``k + 1`` least ids, which is all that any answer can hold of them, and equal queries are asked once.

Defined results: vectors that are null or zero, that hold null or non-finite components, and those with a null id take no part; vectors are near those of their own dimension only;
repeated rows are vectors of their own, and a query's own row is left out once; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotledger.llm.vectors import k_means, prepare
from shotledger.sources.shared import broadcast_if_small, materialise, scratch

MEMBERS, QUERIES, TILE, WIDTH, SEEDS = 2048, 1024, 256, 16, 128


def _square(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row from each centre."""
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T, 0)


class Index:
    """The rotation and the codebooks: what every task is sent."""

    def __init__(self, sample: np.ndarray, codes: int, seed: int = 42):
        d = sample.shape[1]
        self.middle = sample.mean(0)
        spread = np.sqrt(((sample - self.middle) ** 2).sum(1).mean())
        self.scale = float(spread) if np.isfinite(spread) and spread > 0 else 1.0
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
        self.rotation = q * np.sign(np.diag(r))
        x = self.turned(sample)
        self.halves = [h for h in np.array_split(np.arange(d), 2) if len(h)]
        self.books = [k_means(x[:, h], codes) for h in self.halves]
        rest = x - self.centres(self.homes(x))
        variances = np.linalg.svd(rest[:8192], compute_uv=False) ** 2
        self.dimensions = float(variances.sum() ** 2 / max((variances**2).sum(), 1e-300)) if variances.sum() > 0 else 1.0

    def turned(self, raw: np.ndarray) -> np.ndarray:
        return ((raw - self.middle) / self.scale) @ self.rotation

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The list of each rotated vector."""
        cell = np.zeros(len(x), np.int64)
        for h, book in zip(self.halves, self.books):
            cell = cell * len(book) + _square(x[:, h], book).argmin(1)
        return cell

    def parts(self, cells: np.ndarray) -> list[np.ndarray]:
        """The centroid in each half that lists consist of."""
        if len(self.books) == 1:
            return [cells]
        return [cells // len(self.books[1]), cells % len(self.books[1])]

    def centres(self, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([book[p] for book, p in zip(self.books, self.parts(cells))], 1)

    def shelve(self, cells: np.ndarray, counts: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> None:
        """Lists that have members, with their least and greatest distances from the centroid, are put on shelves along each codebook's main axis."""
        along = []
        for book, p in zip(self.books, self.parts(cells)):
            axis = np.linalg.svd(book - book.mean(0), full_matrices=False)[2][0]
            along.append((book @ axis).argsort().argsort()[p])
        order = np.lexsort(along[::-1])
        self.cells, self.inner, self.outer, shelf = cells, inner, outer, np.zeros(len(cells), np.int64)
        on_shelf = now = 0
        for c in order:
            if on_shelf and on_shelf + counts[c] > MEMBERS:
                on_shelf, now = 0, now + 1
            on_shelf += counts[c]
            shelf[c] = now
        by_cell = cells.argsort()
        self.cells, self.inner, self.outer, self.shelf = cells[by_cell], inner[by_cell], outer[by_cell], shelf[by_cell]

    def shelf_of(self, cells: np.ndarray) -> np.ndarray:
        return self.shelf[np.searchsorted(self.cells, cells)]

    def asked(self, x: np.ndarray, reach: np.ndarray, certainty: float | None, some: np.ndarray | None = None) -> np.ndarray:
        """For each rotated query, which lists (those numbered ``some``, or all) on other shelves than its own may hold a vector within its reach."""
        home = self.homes(x)
        some = np.arange(len(self.cells)) if some is None else some
        square, gap = np.zeros((len(x), len(some))), np.zeros((len(x), len(some)))
        own = self.centres(home)
        for h, book, p in zip(self.halves, self.books, self.parts(self.cells[some])):
            square += _square(x[:, h], book)[:, p]
            gap += _square(own[:, h], book)[:, p]
        far = np.sqrt(square)
        share = 1.0 if certainty is None else min(1.0, certainty / math.sqrt(self.dimensions))
        slack = 1e-6 * (1 + far)
        asks = (far - self.outer[some] <= reach[:, None] + slack) & (self.inner[some] - far <= reach[:, None] + slack)
        beyond = square - ((x - own) ** 2).sum(1)[:, None]
        with np.errstate(invalid="ignore"):
            plane = beyond <= 2 * share * reach[:, None] * np.sqrt(gap) + slack
        asks &= plane | ~np.isfinite(reach)[:, None]
        asks &= self.shelf[some][None, :] != self.shelf_of(home)[:, None]
        return asks


def limits(d: int, deviations: float) -> list[tuple[int, int, float]]:
    """Column blocks as ``start, end, limit``: the share of the squared bound that the columns up to ``end`` may hold."""
    found = []
    for a in range(0, d, WIDTH):
        s = min(d, a + WIDTH)
        found.append((a, s, 1.0 if s == d else min(1.0, s / d + deviations * math.sqrt(2 * s * (d - s) / (d * d * (d + 2))))))
    return found


def scan_block(index: Index, q: np.ndarray, m: np.ndarray, allowed: np.ndarray | None, reach: np.ndarray, k: int, first_ids: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and member numbers and distances of each query's ``k`` nearest members within its reach; ``allowed`` says which members a query may see."""
    blocks = limits(q.shape[1], deviations)
    turned = index.turned(m)
    columns = [np.ascontiguousarray(turned[:, a:b], dtype=np.float32) for a, b, _ in blocks]
    sizes = (columns[0] ** 2).sum(1)
    found = []
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(q), TILE):
            raw = q[at : at + TILE]
            tile = index.turned(raw)
            may = np.ones((len(m), len(raw)), bool) if allowed is None else allowed[at : at + TILE].T
            bound = (reach[at : at + TILE] / index.scale) ** 2
            unbounded = np.flatnonzero(~np.isfinite(bound))
            if len(unbounded) and allowed is None and len(m) > k:
                # The k-th of a few members is a first bound.
                bound[unbounded] = np.partition(_square(tile[unbounded], turned[: max(SEEDS, k)]), k - 1, axis=1)[:, k - 1]
            slack = 1e-5 * (bound + (tile**2).sum(1) + 1)
            tile = tile.astype(np.float32)
            a, b, limit = blocks[0]
            part = np.maximum(sizes[:, None] + (tile[:, a:b] ** 2).sum(1)[None, :] - 2 * columns[0] @ tile[:, a:b].T, 0)
            j, i = np.nonzero(may & ~(part > bound * limit + slack))
            part = part[j, i]
            for block, (a, b, limit) in zip(columns[1:], blocks[1:]):
                kept = []
                for c in range(0, len(i), 1 << 16):
                    s = slice(c, c + (1 << 16))
                    part[s] += ((block[j[s]] - tile[i[s], a:b]) ** 2).sum(1)
                    kept.append(~(part[s] > bound[i[s]] * limit + slack[i[s]]))
                keep = np.concatenate(kept) if kept else np.zeros(0, bool)
                i, j, part = i[keep], j[keep], part[keep]
            exact = np.concatenate([np.zeros(0), *[np.sqrt(((raw[i[c : c + 8192]] - m[j[c : c + 8192]]) ** 2).sum(1)) for c in range(0, len(i), 8192)]])
            order = np.lexsort((first_ids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = place < k
            found.append((at + i[best], j[best], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, certainty: float | None = 3.0, deviations: float = 3.0, sample: int = 32768, codes: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest vectors found for each row for which ``is_query`` (over ``vec_id``) holds.

    ``codes`` centroids are fitted for each half of the dimensions, if given; else as many as the fourth root of the table's size asks for, up to an eighth of the sample.
    """
    with scratch(vectors.sparkSession) as kept:
        return kept(_nearest(vectors, is_query, k, certainty, deviations, sample, codes), "nearest")


def _nearest(vectors: DataFrame, is_query: Column, k: int, certainty: float | None, deviations: float, sample: int, codes: int | None) -> DataFrame:
    spark = vectors.sparkSession
    rows, number = prepare(vectors)
    rows = materialise(rows.where("raw is not null and vec_id is not null").withColumn("node", F.unhex(F.md5("raw"))), "vectors")
    asking = rows.where(is_query).select("vec_id", "node")
    # Spark keeps the first rows of each group before it moves any, so a group of copies of any size is k + 1 rows of each task.
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    nodes = few.groupBy("node").agg(F.first("raw").alias("raw"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialise(nodes.join(asking.select("node").distinct().withColumn("asks", F.lit(True)), "node", "left"), "nodes")
    kind = dict(vectors.dtypes)["vec_id"]
    found = spark.createDataFrame([], f"node binary, score double, vec_id {kind}")
    # One row per dimension: as a rule there is one, as all vectors come from one model.
    for size, n in nodes.groupBy(F.octet_length("raw").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect():
        found = found.union(_search(nodes.where(F.octet_length("raw") == size), n, number, kind, k, certainty, deviations, sample, codes))
    answers = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    answers = broadcast_if_small(materialise(answers, "answers"))
    # A query's own row is the first at no distance with its id.
    is_own = lambda x: (x["score"] == 0) & (x["vec_id"] == F.col("query_id"))
    own = F.coalesce(F.array_position(F.transform("found", is_own), F.lit(True)), F.lit(0))
    others = F.filter("found", lambda x, i: i + 1 != F.col("own"))
    joined = asking.withColumnRenamed("vec_id", "query_id").join(answers, "node").withColumn("own", own)
    listed = joined.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "near"))
    return listed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "near.vec_id", "near.score")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query node, of members with all their ids."""
    each = found.select("node", "score", F.explode("ids").alias("vec_id"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("score", "vec_id"))).where(F.col("n") <= k).drop("n")


def _search(nodes: DataFrame, n_nodes: int, number: type, kind: str, k: int, certainty: float | None, deviations: float, sample: int, codes: int | None) -> DataFrame:
    """``node, score, vec_id``, written: the ``k + 1`` nearest rows found for each node that asks. All nodes have one dimension."""
    spark = nodes.sparkSession
    matrix = lambda column: np.stack([np.frombuffer(r.as_buffer(), number) for r in column]).astype(np.float64)
    some = nodes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(sample).collect()
    codes = codes or max(1, min(1 << math.ceil(math.log2(max(1, n_nodes)) / 4), sample // 8))
    index = Index(np.stack([np.frombuffer(r["raw"], number) for r in some]).astype(np.float64), codes)
    fitted = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                x = fitted.value.turned(matrix(part.column(1)))
                home = fitted.value.homes(x)
                far = np.sqrt(((x - fitted.value.centres(home)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(far)], [*part.schema.names, "cell", "far"])

    types = f"node binary, raw binary, ids array<{kind}>, asks boolean"
    placed = materialise(nodes.select("node", "raw", "ids", "asks").mapInArrow(place, f"{types}, cell long, far double"), "placed")
    # One row per list that has members: codes ** 2 at most.
    lists = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("inner"), F.max("far").alias("outer")).toArrow()
    index.shelve(*[lists.column(c).to_numpy() for c in ("cell", "n", "inner", "outer")])
    shared = spark.sparkContext.broadcast(index)

    shelf_of_cell = F.broadcast(spark.createDataFrame(pa.table({"cell": index.cells, "shelf": index.shelf})))  # one row per list
    members = materialise(placed.join(shelf_of_cell, "cell").select("node", "raw", "ids", "cell", "shelf"), "members")
    per_shelf = members.groupBy("shelf").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m_blocks"))

    def met(queries: DataFrame, at_home: bool) -> DataFrame:
        """What the queries find, in blocks: on their own shelves, or in the lists that they ask on others."""

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                    reach = part.column(2).to_numpy(zero_copy_only=False)
                    if at_home:
                        shelves = shared.value.shelf_of(shared.value.homes(shared.value.turned(matrix(part.column(1)))))[:, None]
                    else:
                        asks = shared.value.asked(shared.value.turned(matrix(part.column(1))), reach / shared.value.scale, certainty)
                        shelves = [np.unique(shared.value.shelf[a]) for a in asks]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([list(s) for s in shelves], pa.list_(pa.int64()))], [*part.schema.names, "shelves"])

        def compare(table: pa.Table) -> pa.Table:
            is_member = table.column("is_member").combine_chunks()
            m, q = table.filter(is_member), table.filter(pc.invert(is_member))
            if not m.num_rows or not q.num_rows:
                return pa.table({"node": pa.array([], pa.binary()), "score": pa.array([], pa.float64()), "ids": pa.array([], table.schema.field("ids").type)})
            raw, reach = matrix(q.column("raw")), q.column("reach").to_numpy()
            allowed = None
            if not at_home:
                cells = m.column("cell").to_numpy()
                held, where = np.unique(cells, return_inverse=True)
                allowed = shared.value.asked(shared.value.turned(raw), reach / shared.value.scale, certainty, np.searchsorted(shared.value.cells, held))[:, where]
            ids = m.column("ids").combine_chunks()
            first = pc.list_element(ids, 0).to_numpy(zero_copy_only=False)
            i, j, score = scan_block(shared.value, raw, matrix(m.column("raw")), allowed, reach, k + 1, first, deviations)
            return pa.table({"node": q.column("node").take(pa.array(i)), "score": pa.array(score), "ids": ids.take(pa.array(j))})

        asked = materialise(queries.mapInArrow(ask, "node binary, raw binary, reach double, shelves array<long>").withColumn("shelf", F.explode("shelves")).drop("shelves"), "asked")
        blocks = per_shelf.join(asked.groupBy("shelf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks")), "shelf")
        blocks = broadcast_if_small(materialise(blocks, "blocks"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place_m, place_q = F.pmod(F.xxhash64("node"), F.col("m_blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("q_blocks")).cast("int")
        as_members = members.join(blocks, "shelf").select("shelf", place_m.alias("mb"), every("q_blocks").alias("qb"), F.lit(True).alias("is_member"), "node", "raw", "ids", "cell", F.lit(None).cast("double").alias("reach"))
        none = [F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("long").alias("cell")]
        as_queries = asked.join(blocks, "shelf").select("shelf", every("m_blocks").alias("mb"), place_q.alias("qb"), F.lit(False).alias("is_member"), "node", "raw", *none, "reach")
        return materialise(as_members.union(as_queries).groupBy("shelf", "mb", "qb").applyInArrow(compare, f"node binary, score double, ids array<{kind}>"), "met")

    queries = placed.where("asks").select("node", "raw", F.lit(math.inf).alias("reach"))
    first = met(queries, True)
    # The bound is the distance of the last of k + 1 rows, where there are so many.
    bound = _best(first, k + 1).groupBy("node").agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(math.inf)).alias("reach"))
    second = met(queries.drop("reach").join(bound, "node").select("node", "raw", "reach"), False)
    return materialise(_best(first.union(second), k + 1), "best")
