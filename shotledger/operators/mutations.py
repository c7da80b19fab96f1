"""Edits as new states: each takes whole tables and returns the table after the edit. Times are given, never taken from the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotledger.functions import scalars as X
from shotledger.operators.relations import in_list_order
from shotledger.sources.shared import materialise


def _marked(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``_hit``: whether the key is among ``keys``."""
    k = keys.select(F.col(keys.columns[0]).alias(column)).distinct().withColumn("_hit", F.lit(True))
    return rows.join(k, column, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def soft_delete(photos: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The named photos get the time of deletion; their places stay as they are."""
    return _marked(photos, ids, "photo_id").withColumn("deleted_at", F.when(F.col("_hit"), now).otherwise(F.col("deleted_at"))).select(*photos.columns)


def soft_delete_at(photos: DataFrame, jobs: DataFrame, place: int, now: Column) -> DataFrame:
    """The jobs' photos at a place get the time of deletion. Each is told by its own row and its job, so none is moved by its id."""
    hit = F.col("_hit") & (F.col("order_index") == place)
    return _marked(photos, jobs, "job_id").withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).select(*photos.columns)


def unassign(photos: DataFrame, clusters: DataFrame, now: Column) -> DataFrame:
    """Photos of the clusters lose their cluster and are softly deleted."""
    hit = _marked(photos, clusters, "cluster_id")
    return hit.withColumns({"deleted_at": F.when(F.col("_hit"), now).otherwise(F.col("deleted_at")), "cluster_id": F.when(~F.col("_hit"), F.col("cluster_id"))}).select(*photos.columns)


def clear_cluster(photos: DataFrame, jobs: DataFrame) -> DataFrame:
    """Photos of the jobs lose their cluster and nothing else, as before a new clustering."""
    return _marked(photos, jobs, "job_id").withColumn("cluster_id", F.when(~F.col("_hit"), F.col("cluster_id"))).select(*photos.columns)


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key isn't among the deleted."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def taken_out(rows: DataFrame, keys: DataFrame, column: str, returning: str) -> DataFrame:
    """Key and ``returning`` column of the rows that a deletion takes out."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi").select(column, returning)


def delete_jobs(tables: dict[str, DataFrame], jobs: DataFrame) -> dict[str, DataFrame]:
    """All tables without the jobs: what hangs on a job goes with it, and details with their photos."""
    left = {name: without(rows, jobs, "job_id") for name, rows in tables.items() if name != "photo_details"}
    if "photo_details" in tables:
        details = tables["photo_details"]
        left["photo_details"] = details.join(left["photos"].select("photo_id"), "photo_id", "left_semi").select(*details.columns)
    return left


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces the rows of its keys and adds the others."""
    return without(rows, new.select(key), key).unionByName(new.select(*rows.columns))


def compare_and_set(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """New status where the job still has the time at which the update was triggered; superseded updates change nothing.

    ``updates`` has ``job_id, trigger_ts, new_status``, one row per job.
    """
    u = updates.select("job_id", "trigger_ts", "new_status")
    return jobs.join(u, "job_id", "left").withColumn("status", F.when(F.col("trigger_ts") == F.col("updated_at"), F.col("new_status")).otherwise(F.col("status"))).select(*jobs.columns)


def replace_labels(photos: DataFrame, edits: DataFrame) -> DataFrame:
    """Labels replaced as a whole where the edit has some; a null edit keeps them."""
    return photos.join(edits.select("photo_id", "new_labels"), "photo_id", "left").withColumn("labels", F.coalesce("new_labels", "labels")).select(*photos.columns)


def rename_clusters(clusters: DataFrame, edits: DataFrame) -> DataFrame:
    """New names that aren't empty are taken; new places only above 0."""
    e = edits.select("cluster_id", "new_name", "new_index")
    place = F.when(F.col("new_index") > 0, F.col("new_index")).otherwise(F.col("order_index"))
    return clusters.join(e, "cluster_id", "left").withColumns({"name": F.coalesce(F.nullif("new_name", F.lit("")), "name"), "order_index": place.cast("int")}).select(*clusters.columns)


def sync(clusters: DataFrame, photos: DataFrame, payload: DataFrame, elsewhere: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clusters and photos after a client's whole view: names, places and members as in the payload.

    ``payload`` has ``job_id, cluster_id, name, order_index, photo_ids``. Clusters that aren't of the payload's job are passed over; photos may come from
    anywhere and are numbered by their place in the list, where unknown ids count too; what a photo leaves behind isn't renumbered. If lists share a photo, the last
    cluster by place has it. An empty name is a name; a null name or place keeps the old one.

    Photos from anywhere are met by their id, for which all are moved. Where no list names a photo of another job (unknown ids do no harm), ``elsewhere`` false
    gives the same within the jobs' tasks: tables that are dealt out by job already, all into the same number of parts, aren't moved.
    """
    p = payload.select("job_id", "cluster_id", F.col("name").alias("_name"), F.col("order_index").alias("_index"), "photo_ids")
    if not elsewhere:
        return _sync_in_jobs(clusters, photos, p)
    known = p.join(clusters.select("cluster_id", "job_id"), ["cluster_id", "job_id"], "left_semi")
    new_clusters = clusters.join(p.drop("photo_ids"), ["cluster_id", "job_id"], "left").withColumns(
        {"name": F.coalesce("_name", "name"), "order_index": F.coalesce("_index", "order_index").cast("int")}
    )
    members = known.select("cluster_id", "_index", F.posexplode("photo_ids").alias("_place", "photo_id"))
    last = members.groupBy("photo_id").agg(F.max(F.struct("_index", "cluster_id", "_place")).alias("_to"))
    new_photos = photos.join(last, "photo_id", "left").withColumns({"cluster_id": F.coalesce("_to.cluster_id", "cluster_id"), "order_index": F.coalesce("_to._place", "order_index").cast("int")})
    return new_clusters.select(*clusters.columns), new_photos.select(*photos.columns)


def _sync_in_jobs(clusters: DataFrame, photos: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    # A row without job or cluster says nothing. It isn't filtered, as the filter would go down to what the payload was made of, and that would be moved once more for it.
    says = F.col("job_id").isNotNull() & F.col("cluster_id").isNotNull()
    p = p.withColumns({c: F.when(says, F.col(c)) for c in ("_name", "_index", "photo_ids")}).withColumn("_sent", F.lit(True))
    both = clusters.withColumn("_sent", F.lit(False)).unionByName(p, allowMissingColumns=True)
    # The payload's row of a cluster stands before the cluster itself; where that is missing the payload's is the last.
    whole = Window.partitionBy("job_id", "cluster_id").orderBy(F.desc("_sent"), "_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = both.withColumns({"_name": F.first("_name").over(whole), "_at": F.first("_index").over(whole), "_known": ~F.last("_sent").over(whole)})
    new_clusters = asked.where("not _sent").withColumns({"name": F.coalesce("_name", "name"), "order_index": F.coalesce("_at", "order_index").cast("int")})
    members = asked.where("_sent and _known").select("job_id", "cluster_id", "_index", F.posexplode("photo_ids").alias("_place", "photo_id")).where("photo_id is not null")
    members = members.select("job_id", "photo_id", F.struct("_index", "cluster_id", "_place").alias("_to"))
    last = F.max("_to").over(Window.partitionBy("job_id", "photo_id"))
    placed = photos.withColumn("_own", F.lit(True)).unionByName(members, allowMissingColumns=True).withColumn("_to", last).where("_own")
    new_photos = placed.withColumns({"cluster_id": F.coalesce("_to.cluster_id", "cluster_id"), "order_index": F.coalesce("_to._place", "order_index").cast("int")})
    return new_clusters.select(*clusters.columns), new_photos.select(*photos.columns)


def create_jobs(requests: DataFrame, users: DataFrame) -> DataFrame:
    """New jobs, CREATED; an empty company falls back to the user's."""
    u = users.select("user_id", F.col("company_name").alias("_own"))
    return requests.join(u, "user_id", "left").withColumns({"company_name": X.first_filled(F.col("company_name"), F.col("_own")), "status": F.lit("CREATED")}).drop("_own")


def create_exports(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """New exports, PENDING, for jobs without an open one; empty cover texts fall back to the job's."""
    j = jobs.where("export_is = 'new'").select("job_id", F.col("title").alias("_title"), F.col("company_name").alias("_company"))
    return requests.join(j, "job_id").select("job_id", X.first_filled(F.col("cover_title"), F.col("_title")).alias("cover_title"), X.first_filled(F.col("cover_company_name"), F.col("_company")).alias("cover_company_name"), F.lit("PENDING").alias("status"))


def valid_users(requests: DataFrame) -> Column:
    between = lambda c, a, b: F.char_length(c).between(a, b)
    return between("username", 6, 50) & (F.char_length("password") >= 6) & between("company_name", 2, 50)


def register(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that may be registered: valid, with a name that nobody has; of equal names the first request."""
    fresh = requests.where(valid_users(requests)).join(users.select("username"), "username", "left_anti")
    order = Window.partitionBy("username").orderBy("request")
    return fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "password").select("request", "username", "company_name")


#: Fixed value: name of a cluster whose job has neither a construction type nor a title.
UNNAMED = "이름 없음"


def create_cluster(clusters: DataFrame, photos: DataFrame, jobs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and photos after new clusters are put between the others of their job and take photos over.

    ``requests`` has ``job_id, cluster_id, order_index, photo_ids``, one per job; ``cluster_id`` is the new one's. It is named by the job. The place is clamped to 0 and
    the job's number of clusters, and null is that number; clusters from there on move up. The photos, wherever they are, are numbered from 0 in the
    order of the places that they had. Requests for unknown jobs change nothing.
    """
    name = X.first_filled(F.col("construction_type"), F.col("title"), F.lit(UNNAMED))
    wanted = requests.join(jobs.select("job_id", name.alias("name")), "job_id")
    n = clusters.groupBy("job_id").agg(F.count("*").alias("_n"))
    wanted = wanted.join(n, "job_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    wanted = wanted.withColumn("order_index", X.clamp(F.coalesce("order_index", "_n"), 0, F.col("_n")).cast("int"))
    at = wanted.select("job_id", F.col("order_index").alias("_at"))
    place = F.when(F.col("order_index") >= F.col("_at"), F.col("order_index") + 1).otherwise(F.col("order_index"))
    moved = clusters.join(at, "job_id", "left").withColumn("order_index", place.cast("int")).select(*clusters.columns)
    new = wanted.select(*[F.col(c) if c in ("cluster_id", "job_id", "name", "order_index") else F.lit(None).cast(t).alias(c) for c, t in clusters.dtypes])
    taken = in_list_order(wanted.select(F.col("cluster_id").alias("list_id"), "photo_ids"), photos, by_index=True)
    to = taken.select("photo_id", F.col("list_id").alias("_to"), F.col("order_index").alias("_place"))
    new_photos = photos.join(to, "photo_id", "left").withColumns({"cluster_id": F.coalesce("_to", "cluster_id"), "order_index": F.coalesce("_place", "order_index").cast("int")})
    return moved.unionByName(new), new_photos.select(*photos.columns)


def delete_clusters(clusters: DataFrame, photos: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Clusters and photos after a cluster of each job is deleted: its photos lose it and are softly deleted, the gap is closed.

    ``ids`` has ``cluster_id``, one per job; unknown ones change nothing.
    """
    from shotledger.operators.ordering import close_gap

    gone = clusters.join(ids.select("cluster_id").distinct(), "cluster_id", "left_semi").select("job_id", F.col("order_index").alias("removed_index"))
    return close_gap(without(clusters, ids, "cluster_id"), gone, "job_id"), unassign(photos, clusters.select("cluster_id").join(ids, "cluster_id", "left_semi"), now)


def add_photos(clusters: DataFrame, photos: DataFrame, requests: DataFrame) -> DataFrame:
    """Photos after each cluster took some over: numbered on from the number of photos it had, deleted ones included, in the order of the places that they had.

    ``requests`` has ``cluster_id, photo_ids``; unknown clusters and photos change nothing, and no photo may be asked for twice.
    """
    known = requests.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    taken = in_list_order(known.select(F.col("cluster_id").alias("list_id"), "photo_ids"), photos, by_index=True)
    start = photos.groupBy(F.col("cluster_id").alias("list_id")).agg(F.count("*").alias("_start"))
    to = taken.join(start, "list_id", "left").select("photo_id", F.col("list_id").alias("_to"), (F.coalesce("_start", F.lit(0)) + F.col("order_index")).alias("_place"))
    return photos.join(to, "photo_id", "left").withColumns({"cluster_id": F.coalesce("_to", "cluster_id"), "order_index": F.coalesce("_place", "order_index").cast("int")}).select(*photos.columns)


def move_photos(clusters: DataFrame, photos: DataFrame, moves: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Photos moved to another cluster of their job at a place, and clusters left empty taken away with the gap closed.

    ``moves`` has ``photo_id, cluster_id, to_index``, one per job at most (``replay`` takes many). A null cluster means the job's reserve cluster, which is made if it
    isn't there. Deleted photos hold no place and keep their number, unless they are moved; a move within a cluster to no place changes nothing. A source is empty
    when no active photo but the moved one is in it; the reserve cluster stays.
    """
    from shotledger.operators.ordering import close_gap, insert_at

    home = photos.select("photo_id", "job_id", F.col("cluster_id").alias("from_id"), F.col("deleted_at").isNull().alias("_active"))
    reserve = F.concat(F.col("job_id").cast("string"), F.lit("-reserve"))
    has = clusters.where("name = 'reserve'").groupBy("job_id").agg(F.min("cluster_id").alias("_reserve"))
    wanted = moves.join(home, "photo_id").join(has, "job_id", "left")
    made = wanted.where("cluster_id is null and _reserve is null").select(reserve.alias("cluster_id"), "job_id", F.lit("reserve").alias("name"), F.lit(-1).alias("order_index"))
    wanted = wanted.withColumn("cluster_id", F.coalesce("cluster_id", "_reserve", reserve)).drop("_reserve")
    allowed = clusters.select("cluster_id", "job_id").union(made.select("cluster_id", "job_id"))
    # One row per move: written once, as everything below is made from it.
    wanted = materialise(wanted.join(allowed, ["cluster_id", "job_id"], "left_semi"), "moves")
    made = made.join(wanted, ["cluster_id", "job_id"], "left_semi")
    placed = wanted.where("from_id is null or from_id <> cluster_id or to_index is not null").select("cluster_id", "photo_id", "to_index")
    new_photos = insert_at(photos, placed, counted=F.col("deleted_at").isNull())
    left = wanted.where("from_id <> cluster_id").select(F.col("from_id").alias("cluster_id"))
    # A cluster that a photo left has no other active photo, unless another photo moved in; photos moved away don't count.
    # So photos are counted in each cluster and nothing but counts is moved: moved ones are taken off where they were and added where they are.
    one, moved = F.lit(1).cast("long").alias("_n"), wanted.where("_active")
    counted = photos.where("deleted_at is null").select("cluster_id", one).union(moved.select("from_id", (-F.lit(1)).cast("long"))).union(moved.select("cluster_id", one))
    filled = counted.groupBy("cluster_id").agg(F.sum("_n").alias("_n")).where("_n > 0").select("cluster_id")
    empty = left.join(filled, "cluster_id", "left_anti").join(clusters.where("name <> 'reserve'").select("cluster_id", "job_id", F.col("order_index").alias("removed_index")), "cluster_id")
    empty = materialise(empty, "empty")
    new_photos = unassign(new_photos, empty.select("cluster_id"), now)
    kept = without(clusters, empty.select("cluster_id"), "cluster_id").unionByName(made.select(*clusters.columns))
    return close_gap(kept, empty, "job_id"), new_photos
