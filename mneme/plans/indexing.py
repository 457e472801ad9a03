"""Queries over building and keeping the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.operators import index
from mneme.plans.inputs import DOMAIN_SQL, NOTES_SQL, notes, points, stem_sql
from mneme.storage import table


def index_points(spark: SparkSession, d: str) -> DataFrame:
    """The last state of every point."""
    return index.latest_points(table(spark, d, "chunks"), "source_path", "chunk_id", "run_id", "content_hash", "ingested_at")


def built_points(spark: SparkSession, d: str) -> DataFrame:
    """Points built anew from the embedded chunks of the index, under a new run."""
    rows = index.latest_points(table(spark, d, "chunks"), "text", "source", "source_path", "chunk_id", "header", "domain", "content_hash", "links", "dense", "sparse", "colbert")
    made = index.build_points(rows.where("dense is not null").drop("point_id"), F.col("source_path"), tx.domain_of(F.col("domain")), F.lit("run-2"), F.lower("content_hash"))
    return made.select("point_id", "source_path", "chunk_offset", "domain", "run_id", F.size("colbert").alias("n_rows"), F.size("links").alias("n_links"))


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """The index after the first chunk of every note came again under a new run."""
    rows = points(spark, d, "source_path", "chunk_id", "run_id")
    new = rows.where("chunk_id = 0").withColumn("run_id", F.lit("run-2"))
    return index.upsert(rows, new).select("point_id", "source_path", "run_id")


def stale_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Points left when only each note's greatest run id is kept."""
    rows = points(spark, d, "source_path", "run_id")
    current = rows.groupBy("source_path").agg(F.max("run_id").alias("run_id"))
    return index.delete_stale(rows, current).select("point_id", "source_path", "run_id")


def sources_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Points left when those of notes that are gone are deleted, counted per note."""
    rows = points(spark, d, "source_path")
    gone = rows.select("source_path").distinct().join(table(spark, d, "notes", "source_path"), "source_path", "left_anti")
    return index.delete_sources(rows, gone).groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the feed whose hash the index doesn't have."""
    feed = table(spark, d, "note_feed", "feed_id", "source_path", "op", "content_hash").where("op = 'upsert'")
    return index.changed_files(feed, table(spark, d, "notes", "source_path", "content_hash")).select("feed_id", "source_path")


def note_aggregates(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d, "source_path", "domain", "updated", "quelle")
    return index.note_aggregates(rows)


def domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.domain_counts(points(spark, d, "domain"))


def domain_moves(spark: SparkSession, d: str) -> DataFrame:
    """What bringing the domains into one spelling moves."""
    before = table(spark, d, "chunks", "point_id", "domain").distinct()
    return index.domain_moves(before, points(spark, d, "domain"))


def link_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = notes(spark, d)
    return index.neighbours_by_link(rows, rows)


def request_status(spark: SparkSession, d: str) -> DataFrame:
    return index.request_status(table(spark, d, "note_feed", "source_path").distinct(), "/vault", "source_path")


QUERIES = {f.__name__: f for f in (
    index_points, built_points, upserted, stale_deleted, sources_deleted, changed_files, note_aggregates, domain_counts, domain_moves, link_neighbours, request_status,
)}

_LAST = """last as (select * from chunks qualify row_number() over (partition by point_id order by ingested_at desc) = 1)"""
_UUID = r"regexp_replace(left(sha256(source_path || '::' || chunk_id), 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5')"
ORACLES = {
    "index_points": f"with {_LAST} select point_id, source_path, chunk_id, run_id, content_hash, ingested_at from last",
    "built_points": f"with {_LAST} select {_UUID} as point_id, source_path, chunk_id as chunk_offset, {DOMAIN_SQL.replace('{0}', 'domain')} as domain, 'run-2' as run_id, len(colbert)::int as n_rows, len(links)::int as n_links from last where dense is not null",
    "upserted": f"with {_LAST} select point_id, source_path, case when chunk_id = 0 then 'run-2' else run_id end as run_id from last",
    "stale_deleted": f"with {_LAST} select point_id, source_path, run_id from last qualify run_id is not distinct from max(run_id) over (partition by source_path)",
    "sources_deleted": f"with {_LAST} select source_path, count(*) as n from last where source_path in (select source_path from notes) group by 1",
    "changed_files": "select feed_id, source_path from note_feed f where op = 'upsert' and not exists (select 1 from notes n where n.source_path = f.source_path and lower(n.content_hash) = lower(f.content_hash))",
    "note_aggregates": f"with {_LAST} select source_path, count(distinct point_id) as chunk_count, nullif(trim(lower(arg_min_null(domain, point_id))), '') as domain, arg_min_null(updated, point_id) as updated, arg_min_null(quelle, point_id) as quelle from last where source_path <> '' group by 1",
    "domain_counts": f"select {DOMAIN_SQL.replace('{0}', 'domain')} as domain, count(distinct point_id) as n from chunks where domain is not null group by 1",
    "domain_moves": f"""with a as (select domain, count(distinct point_id) as n from chunks where domain is not null group by 1),
b as (select {DOMAIN_SQL.replace('{0}', 'domain')} as domain, count(distinct point_id) as n from chunks where domain is not null group by 1)
select domain, sum(n)::bigint as delta from (select domain, n from b union all select domain, -n from a) group by 1 having sum(n) <> 0""",
    "link_neighbours": f"""with {NOTES_SQL}, edges as (select source_path as p, unnest(list_distinct(links)) as link from note_rows),
stems as (select source_path as p, domain, {stem_sql('source_path')} as stem from note_rows),
both_ways as (
  select e.p as source_path, s.p as neighbour, true as o, false as i from edges e join stems s on s.stem = e.link
  union all select s.p, e.p, false, true from edges e join stems s on s.stem = e.link
) select source_path, neighbour, any_value(s.domain) as domain, case when bool_or(o) and bool_or(i) then 'both' when bool_or(o) then 'outgoing' else 'incoming' end as direction
from both_ways b join stems s on s.p = b.neighbour where source_path <> neighbour group by 1, 2""",
    "request_status": "select distinct source_path, case when not source_path like '/vault/%' then 'outside' when lower(source_path) like '%.pdf' then 'pdf' when not source_path like '%.md' then 'unsupported' else 'ok' end as status from note_feed",
}
