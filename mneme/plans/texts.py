"""Queries over the scalar functions, on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.functions import vector as vx
from mneme.operators import chunking, retrieval
from mneme.plans.inputs import POINTS_SQL, QUERIES_SQL, UNITS_SQL, WHITE, points, queries, stem_sql, strip_sql, uuid_sql
from mneme.storage import table


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Whether ids made from path and chunk number are the stored ones."""
    rows = table(spark, d, "chunks", "point_id", "source_path", "chunk_id").distinct()
    made = tx.point_id(F.col("source_path"), F.col("chunk_id"))
    return rows.select("point_id", made.alias("made"), (made == F.col("point_id")).alias("same"))


def cache_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_vecs").select("query_id", tx.cache_id(F.col("domain"), F.col("sub_query")).alias("cache_id"))


def section_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks", "source", "header").where("header is not null").distinct()
    return rows.select("source", "header", tx.section_id(F.col("source"), F.col("header")).alias("made"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


def sanitized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", "point_id", "text").distinct().select("point_id", tx.sanitize(F.col("text")).alias("clean"))


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(tx.normalize_query(F.col("text"))).alias("hash"))


def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks", "point_id", "text").distinct()
    return rows.select("point_id", F.explode(tx.wikilinks(F.col("text"))).alias("target"))


def model_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the encoder and the cross-encoder read, as hashes."""
    rows = points(spark, d, "text", "source_path", "header", "document_title")
    return rows.select(
        "point_id", F.md5(tx.embedding_text(F.col("document_title"), F.col("header"), F.col("text"))).alias("embedding"),
        F.md5(tx.passage_text(F.col("source_path"), F.col("header"), F.col("text"))).alias("passage"),
    )


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks", "source_path").distinct()
    p = F.col("source_path")
    return rows.select(p, tx.file_name(p).alias("name"), tx.file_stem(p).alias("stem"), tx.hidden(F.regexp_replace(p, "^/vault/", "")).alias("hidden"))


def ages(spark: SparkSession, d: str) -> DataFrame:
    """Age of every note on a fixed day; the dates are of many forms, some are none."""
    rows = table(spark, d, "notes", "source_path", "updated").distinct()
    days = tx.age_days(F.col("updated"), F.lit("2025-07-01").cast("date"))
    return rows.select("source_path", "updated", days.alias("days"), tx.days_label(days).alias("label"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Domain and indexing flag of composed headers, read back."""
    rows = table(spark, d, "notes", "source_path", "domain", "updated").distinct()
    text = F.concat(F.lit("---\ndomain: "), F.coalesce("domain", F.lit("")), F.lit("\nindexed: "), F.when(F.col("updated").isNull(), "False").otherwise("true"), F.lit("\n---\nbody"))
    header = tx.front_matter(text)
    return rows.select("source_path", "updated", tx.front_matter_domain(header).alias("domain"), tx.front_matter_hides(header).alias("hides"))


def paragraph_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Rule-based pieces of each document taken as one paragraph, as hashes."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return rows.select("doc_id", F.posexplode(tx.sentences(tx.collapse(F.col("text")))).alias("idx", "piece")).select("doc_id", "idx", F.md5("piece").alias("hash"))


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three scores of every logged candidate, computed anew from the vectors."""
    pairs = table(spark, d, "candidates", "query_id", "point_id").distinct()
    p = points(spark, d, "dense", "sparse", "colbert")
    q = table(spark, d, "query_vecs").select("query_id", F.col("dense").alias("qd"), F.col("sparse").alias("qs"), F.col("colbert").alias("qc"))
    units = lambda c: F.transform(c, vx.unit)
    sims = F.when(F.size("colbert") > 0, vx.max_sim(units(F.col("qc")), units(F.col("colbert"))))
    return pairs.join(p, "point_id").join(q, "query_id").select(
        "query_id", "point_id", F.round(vx.cosine(F.col("qd"), F.col("dense")), 6).alias("dense_score"),
        F.round(vx.sparse_dot(F.col("qs"), F.col("sparse")), 6).alias("sparse_score"), F.round(sims, 6).alias("colbert_score"),
    )


def pooled(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each point's token vectors at length one, every coordinate."""
    p = points(spark, d, "colbert").where(F.size("colbert") > 0)
    return p.select("point_id", F.posexplode(vx.pool_dense(F.col("colbert"))).alias("i", "v")).select("point_id", "i", F.round("v", 6).alias("v"))


def chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the Markdown documents that no limit cuts further: header, title, length."""
    docs = table(spark, d, "documents", "doc_id", "text", "fmt").where("fmt = 'note' and text is not null")
    files = docs.select(F.concat(F.lit("/vault/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("markdown"))
    s = chunking.sections_of(files)
    return s.select("path", F.col("section").cast("int").alias("section"), "header", "document_title", F.length("text").alias("n"))


def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of all documents taken as Markdown files, oversized sections cut; texts as hashes."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    files = docs.select(F.concat(F.lit("/vault/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("markdown"))
    return chunking.chunk_markdown(files).withColumn("text", F.md5("text"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of consecutive chunks of each note for one forward pass each."""
    p = points(spark, d, "source_path", "chunk_id", "text").select("source_path", "chunk_id", F.ceil(F.length("text") / 3.1).cast("int").alias("tokens"))
    return chunking.pack_windows(p, "source_path", "chunk_id", F.col("tokens"), limit=600)


def hit_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of every point's text, in order, as hashes."""
    u = points(spark, d, "text").select("point_id", F.posexplode(chunking.units_of(F.col("text"))).alias("idx", "unit"))
    return u.select("point_id", "idx", F.md5("unit").alias("hash"))


def decomposed(spark: SparkSession, d: str) -> DataFrame:
    """Sub-queries from model answers of several forms, with the question itself last."""
    q = table(spark, d, "query_vecs", "query_id", "sub_query")
    a, b = F.concat(F.col("sub_query"), F.lit(" a")), F.concat(F.col("sub_query"), F.lit(" b"))
    answer = (
        F.when(F.col("query_id") % 4 == 0, F.concat(F.lit("Gerne: "), F.to_json(F.array(a, F.col("sub_query"))), F.lit(" fertig")))
        .when(F.col("query_id") % 4 == 1, F.to_json(F.struct(F.array(a, b).alias("queries"))))
        .when(F.col("query_id") % 4 == 2, F.to_json(F.struct(a.alias("x"), b.alias("y"))))
        .otherwise(F.lit("keine Antwort"))
    )
    rows = retrieval.decompose(q.withColumn("answer", answer).withColumnRenamed("sub_query", "question"), retrieval.salvage_list(F.col("answer")))
    return rows.select("query_id", "sub_idx", "sub_query")


QUERIES = {f.__name__: f for f in (
    point_ids, cache_ids, section_ids, content_hashes, sanitized, normalized, wikilinks, model_texts, path_parts, ages, front_matter, paragraph_sentences,
    candidate_scores, pooled, chunk_headers, chunk_markdown, chunk_windows, hit_units, decomposed,
)}

_POINT_ID = uuid_sql("source_path || '::' || chunk_id")
_CACHE_ID = uuid_sql("'cache::' || coalesce(domain, '_global') || '::' || sub_query")
_COLLAPSED = f"regexp_replace(lower(text), '{WHITE}+', ' ', 'g')"
_NO_CODE = "regexp_replace(text, '(?s:```.*?```)|`[^`\\n]*`', '', 'g')"
_TARGETS = rf"unnest(regexp_extract_all({_NO_CODE}, '\[\[([^\]|#]+?)(?:[#|][^\]]*)?\]\]', 1))"
_SECTIONS = rf"""docs as (select '/vault/' || doc_id || '.md' as path, doc_id, text from documents where fmt = 'note' and text is not null),
lines as (select path, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
flagged as (select *, regexp_matches(line, '^#{{1,2}}{WHITE}+.+') as head from lines),
numbered as (select *, sum(head::int) over (partition by path order by i) as s, min(i) over (partition by path) as first_line, bool_or(head) over (partition by path) as headed from flagged),
blocks as (
  select path, doc_id, s, headed, min(i) as at, {strip_sql("string_agg(line, chr(10) order by i)")} as text, first(line order by i) as head_line from numbered group by path, doc_id, s, headed
), titles as (
  select path, first({strip_sql("regexp_extract(line, '^#" + WHITE + "+(.+)$', 1)")} order by i) as title from lines where regexp_matches(line, '^#{WHITE}+.+') group by path
), sections as (
  select b.path, (case when b.headed and exists (select 1 from blocks z where z.path = b.path and z.s = 0) then s when b.headed then s - 1 else 0 end)::int as section,
    case when headed then {strip_sql("regexp_replace(head_line, '^#+', '')")} else doc_id::varchar end as header,
    coalesce(t.title, b.doc_id::varchar) as document_title, b.text
  from blocks b left join titles t using (path) where (not headed or s > 0) and b.text <> ''
)"""
_BEFORE = lambda sep, reach: f"(select case when e > 0 then least(length(text), pos + 2800) - {reach} + e end from (select length(regexp_extract(substr(text, pos + 2801 - {reach}, {reach}), '(?s)^(.*{sep})', 1)) as e))"
#: End of the piece that begins at ``pos``: no shortening, as with 3.1 characters a token every piece of 2,800 fits.
_STOP = rf"""case when pos + 2800 >= length(text) then length(text) else coalesce({_BEFORE(chr(92) + "n" + chr(92) + "n", 500)}, {_BEFORE(chr(92) + "n", 200)}, {_BEFORE(" ", 100)}, pos + 2800) end"""
_WITH = f"with {POINTS_SQL}, {QUERIES_SQL}"
ORACLES = {
    "point_ids": f"select distinct point_id, {_POINT_ID} as made, {_POINT_ID} = point_id as same from chunks",
    "cache_ids": f"select query_id, {_CACHE_ID} as cache_id from query_vecs",
    "section_ids": "select distinct source, header, left(sha256(source || '::' || header), 16) as made from chunks where header is not null",
    "content_hashes": "select doc_id, sha256(text) as hash from documents",
    "sanitized": "select distinct point_id, replace(replace(left(text, 2000), '=== ', '~~~ '), '---', '–––') as clean from chunks",
    "normalized": f"select doc_id, md5({strip_sql(_COLLAPSED)}) as hash from documents",
    "wikilinks": rf"""select distinct point_id, target from (
  select point_id, {strip_sql(_TARGETS)} as target from (select distinct point_id, text from chunks)
) where target <> ''""",
    "model_texts": f"""{_WITH} select point_id, md5(document_title || ' › ' || header || E'\\n\\n' || text) as embedding,
  md5({stem_sql('source_path')} || case when coalesce(header, '') <> '' then ' › ' || header else '' end || E'\\n\\n' || text) as passage from points""",
    "path_parts": f"""select distinct source_path, regexp_extract(source_path, '([^/]*)$', 1) as name, {stem_sql('source_path')} as stem,
  regexp_matches(regexp_replace(source_path, '^/vault/', ''), '(^|/)\\.') as hidden from chunks""",
    "ages": r"""select source_path, updated, days, case when days = 1 then '1 Tag' else days || ' Tage' end as label from (
  select distinct source_path, updated, case when regexp_full_match(updated, '\d{4}-\d{2}-\d{2}') then date_diff('day', try_cast(updated as date), date '2025-07-01') end as days from notes)""",
    "front_matter": r"""select distinct source_path, updated, case when regexp_full_match(trim(coalesce(domain, '')), '\S+') then trim(domain) else '?' end as domain, updated is null as hides from notes""",
    "candidate_scores": f"""{_WITH} select query_id, point_id,
  round(case when list_sum(list_transform(p.dense, lambda x: x * x)) > 0 then list_cosine_similarity(q.dense::double[], p.dense) end, 6) as dense_score,
  round(case when p.sparse is null then null else coalesce((select sum(a.value::double * b.value::double) from (select unnest(map_entries(q.sparse), recursive := true)) a join (select unnest(map_entries(p.sparse), recursive := true)) b on a.key = b.key), 0) end, 6) as sparse_score,
  round(list_sum(list_transform(q.colbert, lambda x: list_max(list_transform(p.colbert, lambda y: list_cosine_similarity(x::double[], y::double[]))))), 6) as colbert_score
  from (select distinct query_id, point_id from candidates) c join points p using (point_id) join query_vecs q using (query_id)""",
    "paragraph_sentences": f"""select doc_id, (generate_subscripts(l, 1) - 1)::int as idx, md5(unnest(l)) as hash from (
  select doc_id, string_split(regexp_replace(regexp_replace(text, '{WHITE}+', ' ', 'g'), '([.!?]) ([A-ZÄÖÜ"„*`[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as l from documents where text is not null)""",
    "pooled": f"""{_WITH}, means as (
  select point_id, list_transform(range(1, len(colbert[1]) + 1), lambda i: list_avg(list_transform(colbert, lambda r: r[i]::double))) as m from points where len(colbert) > 0
), lengths as (select point_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) as l from means)
select point_id, (generate_subscripts(m, 1) - 1)::int as i, round(unnest(m) / l, 6) as v from lengths""",
    "hit_units": f"{_WITH}, {UNITS_SQL} select point_id, idx, md5(unit) as hash from units",
    "chunk_windows": f"""with recursive {POINTS_SQL}, sized as (
  select source_path, chunk_id, ceil(length(text) / 3.1)::int as tokens, row_number() over (partition by source_path order by chunk_id) as n from points
), folded as (
  select source_path, chunk_id, tokens, n, 1 as w, case when tokens > 600 then 601 else tokens end as used from sized where n = 1
  union all
  select s.source_path, s.chunk_id, s.tokens, s.n, case when s.tokens > 600 or f.used + s.tokens > 600 then f.w + 1 else f.w end,
    case when s.tokens > 600 then 601 when f.used + s.tokens > 600 then s.tokens else f.used + s.tokens end
  from folded f join sized s on s.source_path = f.source_path and s.n = f.n + 1
) select source_path, chunk_id, tokens, w as "window" from folded""",
    "chunk_headers": rf"""with {_SECTIONS}
select path, section, header, document_title, length(text)::int as n from sections""",
    "chunk_windows": f"""with recursive {POINTS_SQL}, sized as (
  select source_path, chunk_id, ceil(length(text) / 3.1)::int as tokens, row_number() over (partition by source_path order by chunk_id) as n from points
), folded as (
  select source_path, chunk_id, tokens, n, 1 as w, case when tokens > 600 then 601 else tokens end as used from sized where n = 1
  union all
  select s.source_path, s.chunk_id, s.tokens, s.n, case when s.tokens > 600 or f.used + s.tokens > 600 then f.w + 1 else f.w end,
    case when s.tokens > 600 then 601 when f.used + s.tokens > 600 then s.tokens else f.used + s.tokens end
  from folded f join sized s on s.source_path = f.source_path and s.n = f.n + 1
) select source_path, chunk_id, tokens, w as "window" from folded""",
    "chunk_headers": rf"""with {_SECTIONS}
select path, section, header, document_title, length(text)::int as n from sections""",
    "chunk_markdown": rf"""with recursive {_SECTIONS.replace("fmt = 'note' and ", "")}, pieces as (
  select path, section, header, document_title, text, 0 as pos, {_STOP.replace("pos", "0")} as stop, 1 as tries from sections
  union all
  select path, section, header, document_title, text, stop - 400, {_STOP.replace("pos", "(stop - 400)")}, tries + 1 from pieces where stop < length(text) and stop - 400 > pos
), texts as (select path, section, header, document_title, pos, {strip_sql("substr(text, pos + 1, stop - pos)")} as text from pieces),
parts as (select *, row_number() over (partition by path, section order by pos) as part from texts where text <> '')
select path, regexp_extract(path, '([^/]*)$', 1) as source, (row_number() over (partition by path order by section, part) - 1)::int as chunk_id,
  case when part > 1 then header || ' (Teil ' || part || ')' else header end as header, left(sha256(regexp_extract(path, '([^/]*)$', 1) || '::' || header), 16) as section_id, document_title, md5(text) as text from parts""",
    "decomposed": """
with forms as (
  select query_id, sub_query as q, case query_id % 4 when 0 then [sub_query || ' a', sub_query] when 1 then [sub_query || ' a', sub_query || ' b', sub_query]
    when 2 then [sub_query || ' a', sub_query || ' b', sub_query] else [sub_query] end as l from query_vecs
) select query_id, unnest(l) as sub_query, (generate_subscripts(l, 1) - 1)::int as sub_idx from forms""",
}
