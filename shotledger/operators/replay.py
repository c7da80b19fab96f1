"""Many edits of the same jobs applied in the order of their log, in one pass.

Each edit sees what the edits before it left, so the edits of one job are a sequence; jobs are independent and are spread over tasks. Only the jobs that have
edits are moved, and of their photos only ids, places and times. A job's clusters, photos and edits are one group, as one edit can reach any of them.

Places are kept so that an edit doesn't touch a whole cluster. After an insertion a cluster is dense: its photos are numbered from 0 in the order of a list cut into
blocks, so that a place is found by the blocks' lengths. A photo that leaves keeps its entry open, as those behind it keep their numbers, until the next insertion closes
all open entries; so a number is a rank in the list and is never written before the end. A cluster whose numbers come from the table, or from photos that were added by
count, is loose: a list sorted by number and id.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotledger.functions import scalars as X
from shotledger.operators.mutations import UNNAMED
from shotledger.schemas import RESERVE, RESERVE_INDEX
from shotledger.sources.shared import materialise

KINDS = ("move_photo", "delete_photo", "add_photos", "create_cluster", "update_cluster", "delete_cluster")
BLOCK = 512
#: So many rows of results are put into a batch at least, if there are as many.
OUT_ROWS = 8192


class _Block(list):
    __hash__ = object.__hash__


class Places:
    """A list with entries found by rank and by what they hold; entries can be opened (None) and all open ones be closed."""

    def __init__(self, items: Iterable[str]):
        every = list(items)
        self.blocks = [_Block(every[i : i + BLOCK]) for i in range(0, len(every), BLOCK)]
        self.where: dict[str, _Block] = {p: b for b in self.blocks for p in b}
        self.opened: set[_Block] = set()
        self.length = len(every)

    def rank(self, item: str) -> int:
        own, before = self.where[item], 0
        for b in self.blocks:
            if b is own:
                return before + b.index(item)
            before += len(b)
        raise KeyError(item)

    def open(self, item: str) -> None:
        own = self.where.pop(item)
        own[own.index(item)] = None
        self.opened.add(own)

    def close(self) -> None:
        if self.opened:
            for b in self.opened:
                b[:] = [p for p in b if p is not None]
            self.blocks = [b for b in self.blocks if b]
            self.opened = set()
            self.length = len(self.where)

    def insert(self, place: int, item: str) -> None:
        """Put an item before the entry of rank ``place``; there are no open ones."""
        self.length += 1
        for n, b in enumerate(self.blocks):
            if place <= len(b):
                b.insert(place, item)
                self.where[item] = b
                if len(b) > 2 * BLOCK:
                    tail = _Block(b[BLOCK:])
                    del b[BLOCK:]
                    self.blocks.insert(n + 1, tail)
                    self.where.update(dict.fromkeys((p for p in tail if p is not None), tail))
                return
            place -= len(b)
        self.blocks.append(_Block([item]))
        self.where[item] = self.blocks[-1]

    def pad(self, length: int) -> None:
        """Open entries at the end up to a length."""
        if length > self.length:
            tail = _Block([None] * (length - self.length))
            self.blocks.append(tail)
            self.opened.add(tail)
            self.length = length

    def __iter__(self):
        return (p for b in self.blocks for p in b)


class Members:
    """The photos of a cluster: those that count, in order, and deleted ones."""

    def __init__(self) -> None:
        self.loose: list[tuple[bool, int, str]] | None = []
        self.dense: Places | None = None
        self.dead: set[str] = set()

    def n_active(self) -> int:
        return len(self.loose) if self.dense is None else len(self.dense.where)

    def active(self) -> list[str]:
        return [p for _, _, p in self.loose] if self.dense is None else list(self.dense.where)


def _sortable(number: int | None, item: str) -> tuple[bool, int, str]:
    return (number is None, number or 0, item)


class Job:
    """One job's clusters and photos while its edits are applied."""

    def __init__(self, job_id: object) -> None:
        self.job_id = job_id
        self.clusters: dict[str, list] = {}  # name, place
        self.home: dict[str, str | None] = {}
        self.number: dict[str, int | None] = {}  # of photos in dense clusters only after settle()
        self.dead: set[str] = set()
        self.deleted_at: dict[str, int] = {}
        self.members: dict[str, Members] = {}

    def of(self, cluster: str) -> Members:
        found = self.members.get(cluster)
        if found is None:
            found = self.members[cluster] = Members()
        return found

    def start(self, photo: str, cluster: str | None, number: int | None, dead: bool) -> None:
        self.home[photo], self.number[photo] = cluster, number
        if dead:
            self.dead.add(photo)
        if cluster is not None:
            if dead:
                self.of(cluster).dead.add(photo)
            else:
                self.of(cluster).loose.append(_sortable(number, photo))

    def started(self) -> None:
        for m in self.members.values():
            m.loose.sort()

    def place(self, photo: str) -> int | None:
        home = self.home[photo]
        if home is not None and photo not in self.dead and self.of(home).dense is not None:
            return self.of(home).dense.rank(photo)
        return self.number[photo]

    def take_out(self, photo: str) -> None:
        """The photo leaves its cluster's list with the number that it has."""
        home = self.home[photo]
        if home is None:
            return
        m = self.of(home)
        if photo in m.dead:
            m.dead.remove(photo)
        elif m.dense is not None:
            self.number[photo] = m.dense.rank(photo)
            m.dense.open(photo)
        else:
            del m.loose[bisect.bisect_left(m.loose, _sortable(self.number[photo], photo))]
        self.home[photo] = None

    def put_at(self, cluster: str, photo: str, place: int | None) -> None:
        """The photo goes to a place of the cluster's active photos, and these are numbered anew."""
        self.take_out(photo)
        m = self.of(cluster)
        if m.dense is None:
            m.dense, m.loose = Places(p for _, _, p in m.loose), None
        m.dense.close()
        n = m.dense.length
        place = n if place is None else max(0, min(place, n))
        m.dense.insert(place, photo)
        self.home[photo] = cluster
        if photo in self.dead:  # it has a number, but no later numbering counts it
            m.dense.open(photo)
            self.number[photo] = place
            m.dead.add(photo)

    def put_with(self, cluster: str, photo: str, number: int) -> None:
        """The photo gets a number in the cluster, and the others keep theirs."""
        self.take_out(photo)
        m = self.of(cluster)
        self.home[photo], self.number[photo] = cluster, number
        if photo in self.dead:
            m.dead.add(photo)
        elif m.dense is not None and number >= m.dense.length:
            m.dense.pad(number)
            m.dense.insert(number, photo)
        else:
            if m.dense is not None:
                self.settle(m)
                m.loose, m.dense = sorted(_sortable(self.number[p], p) for p in m.dense.where), None
            bisect.insort(m.loose, _sortable(number, photo))

    def settle(self, m: Members) -> None:
        if m.dense is not None:
            for n, p in enumerate(m.dense):
                if p is not None:
                    self.number[p] = n

    def named(self, photos: Iterable[str] | None) -> list[str]:
        """The job's photos among those named, in the order of their numbers."""
        known = {p for p in photos or () if p in self.home}
        return [p for _, _, p in sorted(_sortable(self.place(p), p) for p in known)]

    def kill(self, photo: str, at: int) -> None:
        home = self.home[photo]
        if photo not in self.dead and home is not None:
            self.take_out(photo)
            self.home[photo] = home
            self.of(home).dead.add(photo)
        self.dead.add(photo)
        self.deleted_at[photo] = at

    def remove_cluster(self, cluster: str, at: int) -> None:
        """Its photos lose it and are deleted, and clusters behind it move up."""
        m = self.of(cluster)
        for photo in [*m.active(), *m.dead]:
            self.take_out(photo)
            self.kill(photo, at)
        _, gone = self.clusters.pop(cluster)
        for c in self.clusters.values():
            if c[1] is not None and gone is not None and c[1] > gone:
                c[1] -= 1

    def apply(self, kind: str, photo: str | None, cluster: str | None, to: int | None, photos: list[str] | None, name: str | None, at: int) -> str | None:
        """Apply an edit, or say why it is refused."""
        if kind in ("move_photo", "delete_photo") and photo not in self.home:
            return "no such photo"
        if kind == "delete_photo":
            self.kill(photo, at)
            return None
        if kind == "move_photo":
            if cluster is None:
                cluster = min((c for c, (n, _) in self.clusters.items() if n == RESERVE), default=None)
                if cluster is None:
                    cluster = f"{self.job_id}-{RESERVE}"
                    self.clusters[cluster] = [RESERVE, RESERVE_INDEX]
            if cluster not in self.clusters:
                return "no such cluster"
            source = self.home[photo]
            if source == cluster:
                if to is not None:
                    self.put_at(cluster, photo, to)
                return None
            self.put_at(cluster, photo, to)
            if source in self.clusters and self.clusters[source][0] != RESERVE and not self.of(source).n_active():
                self.remove_cluster(source, at)
            return None
        if kind == "create_cluster":
            if name is None:
                return "no such job"
            if cluster is None or cluster in self.clusters:
                return "no new cluster"
            n = len(self.clusters)
            to = n if to is None else max(0, min(to, n))
            for c in self.clusters.values():
                if c[1] is not None and c[1] >= to:
                    c[1] += 1
            self.clusters[cluster] = [name, to]
            for k, p in enumerate(self.named(photos)):
                self.put_with(cluster, p, k)
            return None
        if cluster not in self.clusters:
            return "no such cluster"
        if kind == "add_photos":
            m = self.of(cluster)
            first = m.n_active() + len(m.dead)
            for k, p in enumerate(self.named(photos)):
                self.put_with(cluster, p, first + k)
        elif kind == "update_cluster":
            if name:
                self.clusters[cluster][0] = name
            if to is not None and to > 0:
                self.clusters[cluster][1] = to
        elif kind == "delete_cluster":
            self.remove_cluster(cluster, at)
        else:
            return "no such kind of edit"
        return None


NAMES = ("job_id", "is", "id", "parent", "name", "place", "edit_id", "at")


#: What is taken from the rows of a job beside its id.
GIVEN = ("is", "id", "parent", "name", "place", "dead", "edit_id", "kind", "photo_ids", "at")


def _values(column: pa.Array) -> list:
    """The values of an array as a list. Whole columns are turned at once, as an Arrow object for each value takes longer than most edits."""
    kind = column.type
    if pa.types.is_list(kind):
        ends, inner = column.offsets.to_numpy().tolist(), _values(column.values)
        return [inner[a:b] if v else None for a, b, v in zip(ends, ends[1:], column.is_valid().to_numpy(zero_copy_only=False).tolist())]
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(kind) or pa.types.is_boolean(kind):
        found = column.fill_null(0 if pa.types.is_integer(kind) else False).to_numpy(zero_copy_only=False).tolist()
        return found if not column.null_count else [x if v else None for x, v in zip(found, column.is_valid().to_numpy(zero_copy_only=False).tolist())]
    return column.to_pylist()


def _replayed(job_id: object, given: dict[str, list], first: int, end: int, out: list[tuple]) -> None:
    """One job's rows, edits in their order, to what became of them as tuples of ``NAMES``; ``is`` tells clusters, photos and edits apart."""
    what, ids, parents, names, places, dead, edit_ids, kinds, lists, ats = (given[n] for n in GIVEN)
    job = Job(job_id)
    clusters, photos, edits = {}, {}, []
    for r in range(first, end):
        if what[r] == "edit":
            edits.append(r)
        elif what[r] == "cluster":
            clusters[ids[r]] = (names[r], places[r])
        else:
            photos[ids[r]] = (parents[r], places[r])
            job.start(ids[r], parents[r], places[r], dead[r])
    job.clusters = {c: list(x) for c, x in clusters.items()}
    job.started()
    for r in edits:
        why = job.apply(kinds[r], ids[r], parents[r], places[r], lists[r], names[r], ats[r])
        if why:
            out.append((job_id, "refused", why, None, None, None, edit_ids[r], None))
    for m in job.members.values():
        job.settle(m)
    for c, (name, place) in job.clusters.items():
        if clusters.get(c) != (name, place):
            out.append((job_id, "cluster" if c in clusters else "new", c, None, name, place, None, None))
    for c in clusters:
        if c not in job.clusters:
            out.append((job_id, "gone", c, None, None, None, None, None))
    for p, home in job.home.items():
        if p in job.deleted_at or photos[p] != (home, job.number[p]):
            out.append((job_id, "photo", p, home, None, job.number[p], None, job.deleted_at.get(p)))


def _replayed_jobs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What became of the jobs of a partition sorted by job and edit; of its rows only a batch and one job's are held at a time. Times pass through as numbers."""
    held: dict[str, list] = {n: [] for n in ("job_id", *GIVEN)}
    out: list[tuple] = []
    kinds = None

    def done() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()).cast(kinds.field(n).type) if n == "at" else pa.array(c, kinds.field(n).type) for n, c in zip(NAMES, zip(*out))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=list(NAMES))

    for batch in batches:
        kinds = batch.schema
        before = len(held["job_id"])
        for n, c in zip(kinds.names, batch.columns):
            held[n].extend(_values(c.cast(pa.int64()) if n == "at" else c))
        jobs, first = held["job_id"], 0
        for r in range(max(before, 1), len(jobs)):
            if jobs[r] != jobs[r - 1]:
                _replayed(jobs[first], held, first, r, out)
                first = r
                if len(out) >= OUT_ROWS:
                    yield done()
        for c in held.values():
            del c[:first]
    if held["job_id"]:
        _replayed(held["job_id"][0], held, 0, len(held["job_id"]), out)
    if out:
        yield done()


def replay(clusters: DataFrame, photos: DataFrame, jobs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters and photos after all edits in the order of ``edit_id``, and the refused edits as ``job_id, edit_id, reason``.

    ``edits`` has ``edit_id, job_id, kind, photo_id, cluster_id, to_index, photo_ids, name, at``; kinds are

    - ``move_photo``: to a place among the active photos of a cluster (null: the reserve cluster, which is made if it isn't there), the last if the place is null; within a cluster a
      null place changes nothing; a cluster that no active photo is left in goes, unless it is the reserve;
    - ``delete_photo``: softly; it keeps cluster and number;
    - ``add_photos``: ``photo_ids`` in the order of their numbers, numbered on from the count of photos there, deleted ones included;
    - ``create_cluster``: ``cluster_id`` is the new one's, named by the job; at a place among the job's clusters, the last if it is null, with ``photo_ids`` numbered from 0;
    - ``update_cluster``: a ``name`` that isn't empty and a place above 0 are taken;
    - ``delete_cluster``: its photos lose it and are deleted, the gap is closed.

    Places are clamped, edits reach photos and clusters of their own job only, and what can't be done is refused and changes nothing. Numbers that tie are
    ordered by id, null ones last. Edits with one ``edit_id`` in a job are not in a defined order.
    """
    kinds = {"job": dict(photos.dtypes)["job_id"], "at": dict(photos.dtypes)["deleted_at"]}
    title = jobs.select("job_id", X.first_filled(F.col("construction_type"), F.col("title"), F.lit(UNNAMED)).alias("_title"))
    log = edits.join(title, "job_id", "left").withColumn("name", F.when(F.col("kind") == "create_cluster", F.col("_title")).otherwise(F.col("name")))
    touched = edits.select("job_id").distinct()
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    columns = ("job_id", "is", "id", "parent", "name", "place", "dead", "edit_id", "kind", "photo_ids", "at")
    none = {"parent": "string", "name": "string", "place": "int", "dead": "boolean", "edit_id": "long", "kind": "string", "photo_ids": "array<string>", "at": kinds["at"]}

    def rows(df: DataFrame, what: str, **given) -> DataFrame:
        return df.select(*[F.lit(what).alias("is") if c == "is" else given[c].alias(c) if c in given else null(none[c], c) if c in none else F.col(c) for c in columns])

    c = F.col
    all_rows = rows(clusters.join(touched, "job_id", "left_semi"), "cluster", id=c("cluster_id"), name=c("name"), place=c("order_index").cast("int"))
    all_rows = all_rows.union(rows(photos.join(touched, "job_id", "left_semi"), "photo", id=c("photo_id"), parent=c("cluster_id"), place=c("order_index").cast("int"), dead=c("deleted_at").isNotNull()))
    named = F.when(c("kind").isin("add_photos", "create_cluster"), c("photo_ids"))
    given = {"id": c("photo_id"), "parent": c("cluster_id"), "place": c("to_index").cast("int"), "photo_ids": named, "at": c("at").cast(kinds["at"])} | {n: c(n) for n in ("name", "edit_id", "kind")}
    all_rows = all_rows.union(rows(log, "edit", **given))
    # Jobs have few rows and there are many, so a task takes its jobs one after the other from sorted rows; a call of Python for each job's group takes longer than its edits.
    # Dealt out by a hash of its own: a shuffle by the job itself is left out where the joins above seem to have made it, and adaptive execution then changes these.
    by_job = all_rows.repartition(F.xxhash64("job_id")).sortWithinPartitions("job_id", "edit_id")
    changes = by_job.mapInArrow(_replayed_jobs, f"job_id {kinds['job']}, `is` string, id string, parent string, name string, place int, edit_id long, at {kinds['at']}")
    changes = materialise(changes, "changes")
    of = lambda what: changes.where(c("is") == what)
    changed = changes.where(c("is").isin("cluster", "gone")).select(c("id").alias("cluster_id"), c("name").alias("_name"), c("place").alias("_place"), (c("is") == "cluster").alias("_hit"))
    kept = clusters.join(changed, "cluster_id", "left").where(F.coalesce("_hit", F.lit(True))).withColumns({n: F.when(c("_hit"), c(o)).otherwise(c(n)).cast(dict(clusters.dtypes)[n]) for n, o in (("name", "_name"), ("order_index", "_place"))})
    new = of("new").select(*[{"cluster_id": c("id"), "job_id": c("job_id"), "name": c("name"), "order_index": c("place").cast(t)}.get(n, F.lit(None).cast(t)).alias(n) for n, t in clusters.dtypes])
    changed = of("photo").select(c("id").alias("photo_id"), c("parent").alias("_parent"), c("place").alias("_place"), c("at").alias("_at"), F.lit(True).alias("_hit"))
    moved = photos.join(changed, "photo_id", "left").withColumns(
        {
            "cluster_id": F.when(c("_hit"), c("_parent")).otherwise(c("cluster_id")),
            "order_index": F.when(c("_hit"), c("_place")).otherwise(c("order_index")).cast("int"),
            "deleted_at": F.coalesce("_at", "deleted_at"),
        }
    )
    refused = of("refused").select("job_id", "edit_id", c("id").alias("reason"))
    return kept.select(*clusters.columns).unionByName(new), moved.select(*photos.columns), refused
