"""Inputs that several queries share, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.operators import index
from mneme.storage import table

#: White space as Unicode defines it, for SQL patterns.
WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STEM_SQL = r"regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"
UUID_SQL = r"regexp_replace(left(sha256({0}), 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"
DOMAIN_SQL = "nullif(trim(lower({0})), '')"


def stem_sql(path: str) -> str:
    return STEM_SQL.replace("{0}", path)


def uuid_sql(text: str) -> str:
    return UUID_SQL.replace("{0}", text).replace("{{", "{").replace("}}", "}")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def points(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The index as it is: one row per point, with the domain in one spelling."""
    rows = index.latest_points(table(spark, d, "chunks", *dict.fromkeys(["point_id", "ingested_at", *columns])), *columns)
    return rows.withColumn("domain", tx.domain_of(F.col("domain"))) if "domain" in columns else rows


#: Points in SQL; equal rows of a point differ in nothing that queries use.
POINTS_SQL = """points as (
  select point_id, any_value(text) as text, any_value(source_path) as source_path, any_value(source) as source, any_value(chunk_id) as chunk_id,
    any_value(header) as header, any_value(document_title) as document_title, nullif(trim(lower(any_value(domain))), '') as domain,
    any_value(run_id) as run_id, any_value(dense)::double[] as dense, any_value(sparse) as sparse, any_value(colbert) as colbert
  from chunks group by point_id
)"""


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Query vectors as search input: each pair of queries is one question with two sub-queries."""
    q = table(spark, d, "query_vecs")
    return q.select(
        F.floor((F.col("query_id") - 1) / 2).cast("long").alias("query_id"), ((F.col("query_id") - 1) % 2).cast("int").alias("sub_idx"),
        "sub_query", tx.domain_of(F.col("domain")).alias("domain"), "dense", "sparse", "colbert",
    )


QUERIES_SQL = """asked as (
  select (query_id - 1) // 2 as query_id, ((query_id - 1) % 2)::int as sub_idx, sub_query, nullif(trim(lower(domain)), '') as domain,
    dense::double[] as dense, sparse, colbert from query_vecs
)"""


def notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes, once each."""
    return table(spark, d, "notes").groupBy("source_path").agg(
        F.max("domain").alias("domain"), F.max("links").alias("links"), F.max("content_hash").alias("content_hash"), F.min("indexed_at").alias("indexed_at")
    )


NOTES_SQL = """note_rows as (
  select source_path, max(domain) as domain, max(links) as links, max(content_hash) as content_hash, min(indexed_at) as indexed_at from notes group by 1
)"""

_UNIX = r"regexp_replace(text, '\r\n|[\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g')"
#: Units of every point from its lines: fences by parity, runs of lines by what begins them.
UNITS_SQL = rf"""lines as (
  select point_id, generate_subscripts(l, 1) as i, unnest(l) as line from (select point_id, string_split({_UNIX}, chr(10)) as l from points where text is not null)
), bare as (
  select *, {strip_sql("line")} as b, starts_with({strip_sql("line")}, '```') as fence from lines
), parity as (
  select *, sum(fence::int) over (partition by point_id order by i) as f from bare
), kinds as (
  select *, case when f % 2 = 1 or fence then 'code' when b = '' then 'blank' when left(b, 1) in ('#', '|') then 'line'
    when regexp_matches(b, '^(?:[-*] |>|[0-9]+\.{WHITE})') then 'item' else 'text' end as kind from parity
), begun as (
  select *, case kind when 'code' then fence and f % 2 = 1 when 'text' then coalesce(lag(kind) over (partition by point_id order by i) not in ('item', 'text'), true) else true end as begins from kinds
), numbered as (
  select *, sum(begins::int) over (partition by point_id order by i) as u from begun
), runs as (
  select point_id, u, min_by(kind, i) as kind, case when min_by(kind, i) = 'code' then string_agg(line, chr(10) order by i) else string_agg(b, ' ' order by i) end as unit
  from numbered where kind <> 'blank' group by 1, 2
), cut as (
  select point_id, u, case when kind = 'text' and length(unit) > 400 then string_split(regexp_replace(unit, '([.!?]){WHITE}+([A-ZÄÖÜ"„*`[])', '\1' || chr(1) || '\2', 'g'), chr(1)) else [unit] end as l from runs
), pieces as (select point_id, u, generate_subscripts(l, 1) as k, unnest(l) as unit from cut), units as (
  select point_id, (row_number() over (partition by point_id order by u, k) - 1)::int as idx, unit from pieces
  where {strip_sql("unit")} <> '' and not regexp_full_match(unit, '\|[\s:|-]*\|')
)"""
