"""Registered queries over logs of edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotledger.operators import replay
from shotledger.plans.catalog import NOW, ORACLES, query
from shotledger.sources import layout, tables
from shotledger.sources.shared import scratch

#: Edits of each job, one for each of its photos: kinds, targets and places differ by job and place; some name nobody or a cluster that isn't there.
LOG = """, f AS (SELECT job_id, photo_id, cluster_id, order_index AS ln, row_number() OVER (PARTITION BY job_id ORDER BY photo_id) AS n FROM photos),
g AS (SELECT f.*, coalesce(o.photo_id, a.photo_id) AS next_id, coalesce(o.cluster_id, a.cluster_id) AS next_cluster FROM f LEFT JOIN f o ON o.job_id = f.job_id AND o.n = f.n + 1 JOIN f a ON a.job_id = f.job_id AND a.n = 1),
e AS MATERIALIZED (SELECT job_id, n, ['move_photo', 'move_photo', 'move_photo', 'delete_photo', 'create_cluster', 'add_photos', 'delete_cluster'][((job_id + ln * 3) % 7 + 1)::INT] AS kind,
  CASE WHEN (job_id + n) % 17 = 0 THEN 'nobody' ELSE photo_id END AS p,
  CASE (job_id + ln * 3) % 7 WHEN 4 THEN job_id || '-new-' || n WHEN 5 THEN cluster_id WHEN 6 THEN cluster_id ELSE CASE WHEN (job_id + n) % 11 = 0 THEN 'nowhere' WHEN (job_id + n) % 3 <> 0 THEN next_cluster END END AS t,
  nullif((n * 5 + job_id) % 4 - 1, 2)::INT AS k, [photo_id, next_id] AS ids FROM g)"""

#: One edit after the other over each job's state: lists of its photos (p, c, i, d) and clusters (c, n, i).
REPLAY = f"""{LOG},
s AS (
  SELECT j.job_id, 0::BIGINT AS n, coalesce(ps, []) AS ps, coalesce(cs, []) AS cs, j.title FROM jobs j
  LEFT JOIN (SELECT job_id, list({{'p': photo_id, 'c': cluster_id, 'i': order_index::INT, 'd': deleted_at::TIMESTAMP}}) AS ps FROM photos GROUP BY 1) USING (job_id)
  LEFT JOIN (SELECT job_id, list({{'c': cluster_id, 'n': name, 'i': order_index::INT}}) AS cs FROM clusters GROUP BY 1) USING (job_id)
  UNION ALL
  SELECT job_id, n, CASE WHEN gone IS NULL THEN ps ELSE list_transform(ps, lambda x: CASE WHEN x.c = gone THEN {{'p': x.p, 'c': NULL::VARCHAR, 'i': x.i, 'd': TIMESTAMP '{NOW}'}} ELSE x END) END,
    CASE WHEN gone IS NULL THEN cs ELSE list_transform(list_filter(cs, lambda x: x.c <> gone), lambda x: CASE WHEN x.i > list_filter(cs, lambda y: y.c = gone)[1].i THEN {{'c': x.c, 'n': x.n, 'i': x.i - 1}} ELSE x END) END, title
  FROM (SELECT *, CASE WHEN kind = 'delete_cluster' AND has_t THEN t
      WHEN moves AND me.c <> t AND len(list_filter(cs, lambda x: x.c = me.c AND x.n <> 'reserve')) > 0 AND len(list_filter(ps, lambda x: x.c = me.c AND x.d IS NULL)) = 0 THEN me.c END AS gone
  FROM (SELECT job_id, n, title, kind, t, me, has_t, moves, cs, CASE
      WHEN moves AND (me.c IS DISTINCT FROM t OR k IS NOT NULL) THEN list_transform(ps, lambda x: CASE WHEN list_contains(line, x.p) THEN {{'p': x.p, 'c': t, 'i': (list_position(line, x.p) - 1)::INT, 'd': x.d}} ELSE x END)
      WHEN kind = 'delete_photo' THEN list_transform(ps, lambda x: CASE WHEN x.p = p THEN {{'p': x.p, 'c': x.c, 'i': x.i, 'd': TIMESTAMP '{NOW}'}} ELSE x END)
      WHEN (kind = 'add_photos' AND has_t) OR kind = 'create_cluster' THEN list_transform(ps, lambda x: CASE WHEN list_contains(taken, x.p)
        THEN {{'p': x.p, 'c': t, 'i': (list_position(taken, x.p) - 1 + CASE WHEN kind = 'add_photos' THEN len(list_filter(ps, lambda y: y.c = t)) ELSE 0 END)::INT, 'd': x.d}} ELSE x END)
      ELSE ps END AS ps
  FROM (SELECT *, kind = 'move_photo' AND me IS NOT NULL AND has_t AS moves, list_concat(list_concat(others[1:place], [p]), others[place + 1:]) AS line
  FROM (SELECT *, len(list_filter(cs, lambda x: x.c = t)) > 0 AS has_t, greatest(0, least(coalesce(k, len(others)), len(others))) AS place
  FROM (SELECT *, list_transform(list_sort(list_transform(list_filter(ps, lambda x: x.c = t AND x.d IS NULL AND x.p <> p), lambda x: {{'m': x.i IS NULL, 'i': x.i, 'p': x.p}})), lambda x: x.p) AS others,
      list_transform(list_sort(list_transform(list_filter(ps, lambda x: list_contains(ids, x.p)), lambda x: {{'m': x.i IS NULL, 'i': x.i, 'p': x.p}})), lambda x: x.p) AS taken
  FROM (SELECT job_id, n, title, kind, p, k, ids, ps, me, t, CASE WHEN kind = 'move_photo' AND me IS NOT NULL AND len(list_filter(cs, lambda x: x.c = t)) = 0 AND t = job_id || '-reserve' THEN list_append(cs, {{'c': t, 'n': 'reserve', 'i': -1}})
      WHEN kind = 'create_cluster' THEN list_append(list_transform(cs, lambda x: CASE WHEN x.i >= spot THEN {{'c': x.c, 'n': x.n, 'i': x.i + 1}} ELSE x END), {{'c': t, 'n': title, 'i': spot}}) ELSE cs END AS cs
  FROM (SELECT s.job_id, e.n, s.title, e.kind, e.p, e.k, e.ids, ps, cs, list_filter(ps, lambda x: x.p = e.p)[1] AS me, greatest(0, least(coalesce(e.k, len(cs)), len(cs)))::INT AS spot,
      coalesce(e.t, list_filter(cs, lambda x: x.n = 'reserve')[1].c, s.job_id || '-reserve') AS t FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1)))))))),
r AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS back FROM s) WHERE back = 1)
"""


def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """The edits of ``LOG``: ``edit_id, job_id, kind, photo_id, cluster_id, to_index, photo_ids, name, at``."""
    c = F.col
    line = Window.partitionBy("job_id").orderBy("photo_id")
    # A job's first photo follows its last.
    both = lambda name: F.coalesce(F.lead(name).over(line), F.first(name).over(line))
    f = tables.photos(spark, d).select("job_id", "photo_id", "cluster_id", c("order_index").alias("ln"))
    g = f.select("*", F.row_number().over(line).alias("n"), both("photo_id").alias("next_id"), both("cluster_id").alias("next_cluster"))
    kinds = F.array(*[F.lit(k) for k in ("move_photo", "move_photo", "move_photo", "delete_photo", "create_cluster", "add_photos", "delete_cluster")])
    which = ((c("job_id") + c("ln") * 3) % 7).cast("int")
    target = F.when((c("job_id") + c("n")) % 11 == 0, "nowhere").when((c("job_id") + c("n")) % 3 != 0, c("next_cluster"))
    target = F.when(which == 4, F.concat_ws("-new-", "job_id", "n")).when(which.isin(5, 6), c("cluster_id")).otherwise(target)
    photo = F.when((c("job_id") + c("n")) % 17 == 0, "nobody").otherwise(c("photo_id"))
    place = F.nullif((c("n") * 5 + c("job_id")) % 4 - 1, F.lit(2)).cast("int")
    return g.select(
        c("n").cast("long").alias("edit_id"), "job_id", F.element_at(kinds, which + 1).alias("kind"), photo.alias("photo_id"), target.alias("cluster_id"), place.alias("to_index"),
        F.array("photo_id", "next_id").alias("photo_ids"), F.lit(None).cast("string").alias("name"), F.lit(NOW).cast("timestamp").alias("at"),
    )


def _replayed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    jobs = tables.jobs(spark, d).withColumn("construction_type", F.lit(""))
    return replay.replay(tables.clusters(spark, d), tables.photos(spark, d), jobs, edit_log(spark, d))


@query(REPLAY + "SELECT x.p AS photo_id, job_id, x.c AS cluster_id, x.i AS order_index, x.d AS deleted_at FROM (SELECT job_id, unnest(ps) AS x FROM r)", "photos", "clusters", "jobs")
def replay_edits(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as kept:
        return kept(_replayed(spark, d)[1].select("photo_id", "job_id", "cluster_id", "order_index", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at")), "photos")


@query(REPLAY + "SELECT x.c AS cluster_id, job_id, x.n AS name, x.i AS order_index FROM (SELECT job_id, unnest(cs) AS x FROM r)", "photos", "clusters", "jobs")
def replay_edits_clusters(spark: SparkSession, d: str) -> DataFrame:
    with scratch(spark) as kept:
        return kept(_replayed(spark, d)[0].select("cluster_id", "job_id", "name", "order_index"), "clusters")


@query(ORACLES["job_details"])
def bucketed_job_details(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with clusters and photos over tables in buckets of the job: only the writing of the buckets moves rows."""
    with layout.Layout(spark, buckets=layout.buckets_for(tables.photos(spark, d))) as laid, scratch(spark) as kept:
        for name, rows in (("jobs", tables.jobs(spark, d)), ("clusters", tables.clusters(spark, d)), ("photos", tables.photos(spark, d)), ("runs", tables.exports(spark, d))):
            laid.write(name, rows)
        found = layout.details_by_job(*[laid.table(x) for x in ("jobs", "clusters", "photos", "runs")])
        ids = lambda photos: F.array_join(F.transform(photos, lambda p: p["photo_id"]), ",")
        inner = F.array_join(F.transform("clusters", lambda c: F.concat(c["cluster_id"], F.lit(":"), ids(c["photos"]))), ";")
        out = found.select("job_id", F.size("photos").cast("long").alias("n_photos"), ids(F.col("photos")).alias("photo_ids"), F.size("clusters").cast("long").alias("n_clusters"), inner.alias("cluster_photos"))
        return kept(out, "details")


@query("SELECT photo_id, job_id, cluster_id FROM photos WHERE job_id IN (SELECT min(job_id) FROM jobs GROUP BY user_id % 40)", "photos", "jobs")
def bucketed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Photos of a few jobs, read from these jobs' buckets only."""
    with layout.Layout(spark, buckets=layout.buckets_for(tables.photos(spark, d))) as laid, scratch(spark) as kept:
        laid.write("photos", tables.photos(spark, d))
        ids = tables.jobs(spark, d).groupBy(F.col("user_id") % 40).agg(F.min("job_id").alias("job_id")).select("job_id")
        return kept(laid.lookup("photos", ids).select("photo_id", "job_id", "cluster_id"), "photos")
