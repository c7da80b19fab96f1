"""Near-duplicates among embeddings by product quantisation: coarse inverted lists with residual codes.

An index is fitted on a bounded sample (``sample`` vectors of each dimension, by hash of their bytes): k-means centroids for the lists, and per group of
components a codebook for what is left after subtracting the centroid. Every vector is indexed: its nearest list, its code, and
the exact error of its code. Every vector is also a query: it asks the lists that can hold a link of it, where table lookups give its
product with each member's code. The error of the code bounds how far that can be from the true one, so the
lookups drop only what can't link; what is left is compared by exact cosine in double precision.

Which lists can hold a link follows from bounds on distances, not from a fixed number of probes: the list's least and greatest distance from its
centroid, and the plane half-way between its centroid and the query's own, which a member can't be short of. A member within the linking distance
could be as far beyond that plane as the whole distance, but differences of near vectors spread over all effective dimensions, so along one direction they
are that distance divided by the dimensions' root, give or take: ``certainty`` is how many times that is allowed for. At the default of 4 the tests
find over 99.9 % of all links, also in a group of near copies that holds a third of the rows; None allows for the whole distance, which loses no
link and asks most lists where dimensions are many. Of two lists only the one earlier in their order asks the other. ``probes`` replaces the
bounds by so many nearest lists.

Lists are put on shelves of about ``MEMBERS`` members, along their main axis, and a query goes once to each shelf that it asks. Shelves are cut into
blocks of members and of queries, so that a list that holds a third of all vectors is many tasks. Blocks don't put
out pairs: they count links per vector and give a spanning set of the links for the components. Equal vectors are one node with a count.

Defined results: vectors that are null or zero, or that hold null or non-finite components, link with nothing; vectors link with those of their own dimension
only; repeated rows are vectors that link; null ids don't name a component unless all its ids are null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.operators.components import components
from shotledger.sources.shared import materialise, scratch

GROUPS, CODES, MEMBERS, QUERIES = 16, 256, 2048, 4096


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepare(vectors: DataFrame) -> tuple[DataFrame, type]:
    """``vec_id, raw``: the components' bytes, null where a vector can't link."""
    kinds = {f.name: f.dataType for f in vectors.schema}
    single = kinds["embedding"].elementType.typeName() == "float"
    number = np.float32 if single else np.float64
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for x in batch.column(1):
                x = x.values if x.is_valid else None
                if x is None or len(x) == 0 or x.null_count:
                    raws.append(None)
                    continue
                x = x.to_numpy()
                raws.append(x.astype(number).tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], ["vec_id", "raw"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id'].simpleString()}, raw binary"), number


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(x[i : i + 4096], centres) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Centroids and codebooks, small enough to send to every task: at most ``sample / 8`` lists."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = k_means(sample, lists)
        self.splits = np.array_split(np.arange(sample.shape[1]), min(GROUPS, sample.shape[1]))
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.books = [k_means(rest[:8192, s], min(CODES, max(1, len(rest) // 4))) for s in self.splits]
        # Effective dimensions of what is left: as many as directions of equal spread would give the same ratio.
        spread = np.linalg.svd(rest[:8192], compute_uv=False) ** 2
        self.dimensions = float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)) if spread.sum() > 0 else 1.0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest lists; codes of what is left; the codes' errors; distances from the centroids."""
        home = _nearest(x, self.centres)
        rest = x - self.centres[home]
        codes = np.stack([_nearest(rest[:, s], b) for s, b in zip(self.splits, self.books)], 1)
        error = np.sqrt(sum(((rest[:, s] - b[codes[:, g]]) ** 2).sum(1) for g, (s, b) in enumerate(zip(self.splits, self.books))))
        return home, codes.astype(np.uint8), error, np.linalg.norm(rest, axis=1)

    def shelve(self, held: dict[int, tuple[int, float, float]]) -> None:
        """From each list's members and their least and greatest distance from its centroid: the order of lists and their shelves."""
        k = len(self.centres)
        self.inner, self.outer = np.full(k, np.inf), np.full(k, -np.inf)
        self.rank, self.shelf = np.zeros(k, int), np.zeros(k, int)
        axis = np.linalg.svd(self.centres - self.centres.mean(0), full_matrices=False)[2][0]
        on_shelf = shelf = 0
        for place, c in enumerate((self.centres @ axis).argsort()):
            n, self.inner[c], self.outer[c] = held.get(int(c), (0, np.inf, -np.inf))
            if on_shelf and on_shelf + n > MEMBERS:
                on_shelf, shelf = 0, shelf + 1
            on_shelf += n
            self.rank[c], self.shelf[c] = place, shelf

    def asked(self, x: np.ndarray, home: np.ndarray, least: float, probes: int | None, certainty: float | None, lists: np.ndarray | None = None) -> np.ndarray:
        """For each vector, which of the lists (all, if none are given) it asks: those that can hold a link of it, where they come after its own; or its ``probes`` nearest."""
        some = np.arange(len(self.centres)) if lists is None or probes is not None else lists
        centres, own = self.centres[some], self.centres[home]
        sizes = (centres**2).sum(1)[None, :]
        square = np.maximum((x**2).sum(1)[:, None] + sizes - 2 * x @ centres.T, 0)
        if probes is not None:
            asks = np.zeros(square.shape, bool)
            np.put_along_axis(asks, square.argpartition(min(probes, square.shape[1]) - 1, axis=1)[:, :probes], True, 1)
        else:
            share = 1.0 if certainty is None else min(1.0, certainty / math.sqrt(self.dimensions))
            gap = np.sqrt(np.maximum((own**2).sum(1)[:, None] + sizes - 2 * own @ centres.T, 0))
            asks = square - ((x - own) ** 2).sum(1)[:, None] <= 2 * share * reach(least) * gap + 1e-6
            far = np.sqrt(square)
            asks &= (far - self.outer[some] <= reach(least)) & (self.inner[some] - far <= reach(least)) & (self.rank[some] > self.rank[home][:, None])
        asks[some[None, :] == home[:, None]] = True
        return asks if lists is None or probes is None else asks[:, lists]

    def products(self, queries: np.ndarray, where: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of coded members (rows) with queries (columns), by table lookup, in single precision."""
        lists, place = np.unique(where, return_inverse=True)
        total = (self.centres[lists] @ queries.T).astype(np.float32)[place]
        for g, (s, b) in enumerate(zip(self.splits, self.books)):
            total += (b @ queries[:, s].T).astype(np.float32)[codes[:, g]]
        return total

    def decoded(self, where: np.ndarray, codes: np.ndarray) -> np.ndarray:
        x = self.centres[where]
        for g, (s, b) in enumerate(zip(self.splits, self.books)):
            x[:, s] += b[codes[:, g]]
        return x


def reach(least: float) -> float:
    """The distance within which unit vectors link, and a little for rounding."""
    return math.sqrt(max(0, 2 - 2 * least)) + 1e-6


def block_links(index: Index, q: dict, m: dict, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Query and member numbers of the links between a block's queries and the members whose lists they ask, a node with itself left out."""
    # ``asks`` has a column for each of the lists ``held`` among the members, ``place`` is a member's column.
    # |q - m| >= |q - code| - error, written for the product of q and code; the last term is far over what single precision loses.
    need = (1 + (index.decoded(m["list"], m["codes"]) ** 2).sum(1) - (reach(least) + m["error"]) ** 2) / 2 - 1e-4
    found = []
    for a in range(0, len(q["unit"]), 512):
        part, asks = q["unit"][a : a + 512], q["asks"][a : a + 512]
        some = np.flatnonzero(asks.any(0)[m["place"]])
        if not len(some):
            continue
        close = (index.products(part, m["list"][some], m["codes"][some]) >= need[some, None]) & asks.T[m["place"][some]]
        if close.mean() > 0.1:
            j, i = np.nonzero(close & (m["unit"][some] @ part.T >= least))
        else:
            j, i = np.nonzero(close)
            good = np.einsum("ij,ij->i", part[i], m["unit"][some[j]]) >= least
            i, j = i[good], j[good]
        j = some[j]
        other = q["number"][a + i] != m["number"][j]
        found.append((a + i[other], j[other]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_classes(vectors: DataFrame, least: float = 0.9, certainty: float | None = 4.0, probes: int | None = None, sample: int = 32768, lists: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector; ``least`` is the cosine of a link, ``sample`` bounds what the index is fitted on; ``certainty`` None loses no link, ``probes``, if given, loses some."""
    with scratch(vectors.sparkSession) as kept:
        return kept(_link_classes(vectors, least, certainty, probes, sample, lists), "link_classes")


def _link_classes(vectors: DataFrame, least: float, certainty: float | None, probes: int | None, sample: int, lists: int | None) -> DataFrame:
    rows, number = prepare(vectors)
    rows = materialise(rows.withColumn("node", F.unhex(F.md5("raw"))), "vectors")
    nodes = rows.where("raw is not null").groupBy("node").agg(F.first("raw").alias("raw"), F.count("*").alias("copies"))
    nodes = materialise(nodes, "nodes")
    found = rows.sparkSession.createDataFrame([], "node binary, links long, other binary")
    # One row per dimension: as a rule there is one, as all vectors come from one model.
    for size, n in nodes.groupBy(F.octet_length("raw").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect():
        found = found.union(_links(nodes.where(F.octet_length("raw") == size), n, number, least, certainty, probes, sample, lists))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    credit = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_node = materialise(nodes.select("node", "copies").join(credit, "node", "left").join(roots, "node", "left"), "by_node")
    keyed = rows.select("vec_id", "node", "raw").join(by_node, "node", "left").withColumn("class", F.when(F.col("raw").isNotNull(), F.coalesce("root", "node")))
    lowest = materialise(keyed.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("lowest")), "lowest")
    component = F.when(F.col("class").isNotNull(), F.col("lowest")).otherwise(F.col("vec_id"))
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
    return keyed.join(lowest, "class", "left").select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(nodes: DataFrame, n_nodes: int, number: type, least: float, certainty: float | None, probes: int | None, sample: int, lists: int | None) -> DataFrame:
    """``node, links, other``, written: per block and node its links there, copies counted, and a node that they lead to. All nodes have one dimension."""
    spark = nodes.sparkSession
    some = nodes.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(sample).collect()
    fitted = unit(np.stack([np.frombuffer(r["raw"], number) for r in some]))
    lists = lists or 1 << math.ceil(math.log2(max(1, n_nodes)) / 2)
    index = Index(fitted, max(1, min(lists, sample // 8)))
    fitted_on = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                x = unit(np.stack([np.frombuffer(r.as_buffer(), number) for r in part.column(1)]))
                home, codes, error, far = fitted_on.value.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far)],
                    ["node", "raw", "copies", "list", "codes", "error", "far"],
                )

    placed = materialise(nodes.select("node", "raw", "copies").mapInArrow(place, "node binary, raw binary, copies long, list int, codes binary, error double, far double"), "placed")
    index.shelve({r["list"]: (r["m"], r["inner"], r["outer"]) for r in placed.groupBy("list").agg(F.count("*").alias("m"), F.min("far").alias("inner"), F.max("far").alias("outer")).collect()})
    shared = spark.sparkContext.broadcast(index)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                x, home = unit(np.stack([np.frombuffer(r.as_buffer(), number) for r in part.column("raw")])), part.column("list").to_numpy()
                shelves = [np.unique(shared.value.shelf[a]).astype(np.int32) for a in shared.value.asked(x, home, least, probes, certainty)]
                shelf = shared.value.shelf[home].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shelf), pa.array(shelves, pa.list_(pa.int32()))], [*part.schema.names, "shelf", "shelves"])

    types = "node binary, raw binary, copies long, list int, codes binary, error double"
    asking = materialise(placed.drop("far").mapInArrow(ask, f"{types}, shelf int, shelves array<int>"), "asking")
    members = asking.groupBy("shelf").agg(F.count("*").alias("m"))
    probing = asking.select(F.explode("shelves").alias("shelf")).groupBy("shelf").agg(F.count("*").alias("q"))
    blocks = members.join(probing, "shelf").select("shelf", F.ceil(F.col("m") / MEMBERS).cast("int").alias("m_blocks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("q_blocks"))
    blocks = F.broadcast(materialise(blocks, "blocks"))  # one row per shelf
    place_m = F.pmod(F.xxhash64("node"), F.col("m_blocks")).cast("int")
    place_q = F.pmod(F.xxhash64("node", F.lit(1)), F.col("q_blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["node", "raw", "copies", "list", "codes", "error"]
    as_members = asking.drop("shelves").join(blocks, "shelf").select("shelf", place_m.alias("mb"), every("q_blocks").alias("qb"), F.lit(True).alias("is_member"), *cols)
    asked = asking.drop("shelf").withColumn("shelf", F.explode("shelves")).join(blocks, "shelf")
    none = {"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")}
    as_queries = asked.select("shelf", every("m_blocks").alias("mb"), place_q.alias("qb"), F.lit(False).alias("is_member"), *[none[c].alias(c) if c in none else F.col(c) for c in cols])

    def compare(table: pa.Table) -> pa.Table:
        is_member = table.column("is_member").combine_chunks()
        m, q = table.filter(is_member), table.filter(pc.invert(is_member)).sort_by("list")
        empty = pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.binary())})
        if not m.num_rows or not q.num_rows:
            return empty
        matrix = lambda t: unit(np.stack([np.frombuffer(r.as_buffer(), number) for r in t.column("raw")]))
        ids = q.column("node").to_pylist() + m.column("node").to_pylist()
        places: dict[bytes, int] = {}
        numbers = np.array([places.setdefault(x, len(places)) for x in ids])
        key = list(places)
        nq = q.num_rows
        codes = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in m.column("codes")])
        of_q, of_m, units = q.column("list").to_numpy(), m.column("list").to_numpy(), matrix(q)
        held, where = np.unique(of_m, return_inverse=True)
        own = {"unit": matrix(m), "list": of_m, "place": where, "codes": codes, "error": m.column("error").to_numpy(), "number": numbers[nq:]}
        asks = shared.value.asked(units, of_q, least, probes, certainty, held)
        i, j = block_links(shared.value, {"unit": units, "asks": asks, "number": numbers[:nq]}, own, least)
        if not len(i):
            return empty
        mult_q, mult_m = q.column("copies").to_numpy(), m.column("copies").to_numpy()
        links = np.zeros(len(key), np.int64)
        np.add.at(links, numbers[:nq][i], mult_m[j])
        # A link is counted at both ends: at the member's here, unless it asks the query's list itself.
        if probes is None:
            unseen = of_m[j] != of_q[i]
        else:
            back, column = np.unique(of_q, return_inverse=True)
            unseen = ~shared.value.asked(own["unit"], of_m, least, probes, certainty, back)[j, column[i]]
        np.add.at(links, numbers[nq:][j[unseen]], mult_q[i[unseen]])
        label = _labels(len(key), numbers[:nq][i], numbers[nq:][j])
        touched = np.unique(np.concatenate([numbers[:nq][i], numbers[nq:][j]]))
        return pa.table({"node": pa.array([key[k] for k in touched], pa.binary()), "links": pa.array(links[touched]), "other": pa.array([key[label[k]] for k in touched], pa.binary())})

    found = as_members.union(as_queries).groupBy("shelf", "mb", "qb").applyInArrow(compare, "node binary, links long, other binary")
    return materialise(found, "found")


def oracle_sql(least: float = 0.9) -> str:
    """All pairs, as SQL."""
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {least}),
reach AS (SELECT r AS s, r AS t FROM v UNION SELECT reach.s, l.b FROM reach JOIN l ON reach.t = l.a),
c AS (SELECT s AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY 1),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, v.vec_id IS NULL) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""
