"""Queries over references between tables and over changes between runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mneme.operators import changefeed, references
from mneme.plans.inputs import stem_sql, strip_sql
from mneme.storage import table


def _references(spark: SparkSession, d: str) -> DataFrame:
    return references.vault_references(
        table(spark, d, "notes", "source_path", "links", "indexed_at"),
        table(spark, d, "chunks", "point_id", "source_path", "ingested_at"),
        table(spark, d, "note_feed", "source_path", "op", "seen_at"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.dangling(_references(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(_references(spark, d))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    """Counts per table, month and status, the status by the intervals in which the parent was there."""
    history = references.vault_history(
        table(spark, d, "notes", "source_path", "links", "indexed_at"),
        table(spark, d, "chunks", "point_id", "source_path", "ingested_at"),
        table(spark, d, "note_feed", "source_path", "op", "seen_at"),
    )
    return references.report(history)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.run_changes(table(spark, d, "note_feed", *changefeed.FEED), table(spark, d, "ingest_runs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("run_no", "source_path")


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d)


QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_history": p5_history, "p7_found": p7_found, "p7_changes": p7_changes}

_STEM = stem_sql("source_path")
_TARGET = strip_sql("regexp_extract(link, '^([^#|]*)', 1)")
_REFS = rf"""
with parents as (
  select source_path, min(indexed_at) as valid_from, true as present from notes where source_path is not null group by 1
  union all
  select source_path, null, false from note_feed
  where op = 'upsert' and seen_at is not null and source_path not in (select source_path from notes where source_path is not null)
  group by 1
), by_stem as (
  select {_STEM} as key, bool_or(present) as present, min(valid_from) as present_from from parents group by 1
), by_path as (
  select source_path as key, bool_or(present) as present, min(valid_from) as present_from from parents group by 1
), links as (
  select source_path, indexed_at, {_TARGET} as target
  from (select source_path, indexed_at, unnest(links) as link from notes)
), refs as (
  select 'notes' as tab, source_path, target, target as key, min(indexed_at) as made from links
  where target is not null and target <> '' group by 2, 3
), chunk_refs as (
  select 'chunks' as tab, source_path, source_path as target, source_path as key, min(ingested_at) as made from chunks
  where source_path is not null group by point_id, source_path
), classified as (
  select r.*, case when p.key is null then 'missing' when not p.present then 'deleted'
    when p.present_from > r.made then 'late' else 'ok' end as status from refs r left join by_stem p using (key)
  union all
  select r.*, case when p.key is null then 'missing' when not p.present then 'deleted'
    when p.present_from > r.made then 'late' else 'ok' end from chunk_refs r left join by_path p using (key)
)
"""
_HISTORY = rf"""
with seen as (
  select source_path as path, seen_at, bool_or(op = 'delete') as gone from note_feed where source_path is not null and seen_at is not null and op in ('upsert', 'delete') group by 1, 2
), turned as (select *, lag(gone) over (partition by path order by seen_at) as before from seen),
turns as (select *, lead(seen_at) over (partition by path order by seen_at) as next from turned where before is null or before <> gone),
present as (select source_path as path, min(indexed_at) as valid_from from notes where source_path is not null group by 1),
intervals as (
  select path, seen_at as valid_from, next as valid_to from turns where not gone and next is not null
  union all
  select t.path, t.seen_at, (select max(s.seen_at) from seen s where s.path = t.path) from turns t where not gone and next is null and t.path not in (select path from present)
  union all
  select path, valid_from, null from present
), keyed as (
  select 'notes' as tab, {stem_sql('path')} as key, valid_from, valid_to from intervals
  union all
  select 'chunks', path, valid_from, valid_to from intervals
), known as (select tab, key, bool_or(valid_to is null) as present, min(valid_from) as first from keyed group by 1, 2),
links as (
  select source_path, indexed_at, {_TARGET} as target
  from (select source_path, indexed_at, unnest(links) as link from notes)
), refs as (
  select 'notes' as tab, source_path, target, min(indexed_at) as made from links where target is not null and target <> '' group by 2, 3
  union all
  select 'chunks', source_path, source_path, min(ingested_at) from chunks where source_path is not null group by point_id, source_path
), placed as (
  select r.*, k.present, made < k.first as early, exists (
    select 1 from keyed i where i.tab = r.tab and i.key = r.target and i.valid_from <= r.made and (i.valid_to is null or r.made < i.valid_to)) as inside
  from refs r left join known k on k.tab = r.tab and k.key = r.target
)
select tab, strftime(made, '%Y-%m') as month, case when present is null then 'missing' when present then case when inside then 'ok' when early then 'late' else 'away' end
  when inside or early then 'deleted' else 'after' end as status, count(*) as n_references, count(distinct target) as n_targets from placed group by all
"""
_STATES = """
with success as (
  select run_no, started_at, row_number() over (order by started_at, run_no) as v from ingest_runs
  where status = 'success' and started_at is not null
), states as (
  select s.v, s.run_no, f.source_path, f.op, lower(f.content_hash) as content_hash,
    row_number() over (partition by s.v, f.source_path order by f.seen_at desc, f.feed_id desc) as newest
  from success s join note_feed f on f.landed_at <= s.started_at
  where f.source_path is not null and f.seen_at is not null and (f.op = 'delete' or f.content_hash is not null)
), present as (select * from states where newest = 1 and op <> 'delete')
select a.run_no, a.source_path{hash} from present a left join present b on b.v = a.v - 1 and b.source_path = a.source_path
where b.source_path is null or b.content_hash <> a.content_hash
"""
ORACLES = {
    "p5_found": _REFS + "select distinct tab, source_path, target from classified where status in ('missing', 'deleted')",
    "p5_report": _REFS
    + "select tab, strftime(made, '%Y-%m') as month, status, count(*) as n_references, count(distinct target) as n_targets from classified group by all",
    "p5_history": _HISTORY,
    "p7_found": _STATES.replace("{hash}", ""),
    "p7_changes": _STATES.replace("{hash}", ", a.content_hash"),
}
