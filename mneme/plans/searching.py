"""Queries over retrieval, fusion, the result cache and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mneme import models
from mneme.functions import text as tx
from mneme.functions import vector as vx
from mneme.operators import answer, cache, compress, retrieval
from mneme.operators.chunking import units_of
from mneme.plans.inputs import POINTS_SQL, QUERIES_SQL, UNITS_SQL, points, queries, stem_sql
from mneme.storage import table

NOW = "2025-07-01 00:00:00"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d, "domain", "source_path", "dense", "sparse", "colbert")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest points of every query, over all domains."""
    asked = queries(spark, d).withColumn("domain", F.lit(None).cast("string"))
    return _rounded(retrieval.dense_topn(asked, _points(spark, d), 10))


def dense_topk_domain(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.dense_topn(queries(spark, d), _points(spark, d), 10))


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.sparse_topn(queries(spark, d), _points(spark, d), 10))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Late-interaction top ten of dense and sparse candidates, per sub-query."""
    return _rounded(retrieval.hybrid(queries(spark, d), _points(spark, d), 10))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The two dense lists of every question fused."""
    lists = retrieval.dense_topn(queries(spark, d), _points(spark, d), 30)
    return retrieval.rrf(lists).where("rank <= 10")


def search_batch(spark: SparkSession, d: str) -> DataFrame:
    """The whole search of all questions in one plan."""
    return retrieval.search(queries(spark, d), _points(spark, d), top_k=10, most_subs=2)


def find_related(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest points of other notes for the notes that evaluation cases ask for."""
    p = _points(spark, d)
    wanted = table(spark, d, "gold_cases", "soll").select(F.explode("soll.notiz").alias("stem")).distinct()
    anchors = retrieval.anchor_vectors(p).withColumn("stem", tx.file_stem(F.col("source_path"))).join(wanted, "stem")
    numbered = anchors.withColumn("query_id", F.conv(F.substring(F.sha2("source_path", 256), 1, 12), 16, 10).cast("long"))
    found = retrieval.related(numbered.select("query_id", "source_path", "dense"), p, 5)
    return _rounded(found.join(numbered.select("query_id", "source_path"), "query_id").drop("query_id"))


def _scored_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.dense_topn(queries(spark, d), _points(spark, d), 15)
    texts = points(spark, d, "text")
    asked = queries(spark, d).select("query_id", "sub_idx", "sub_query")
    rows = hits.join(texts, "point_id").join(asked, ["query_id", "sub_idx"])
    return models.score(rows, F.col("sub_query"), F.col("text"), models.overlap_scorer).drop("text", "sub_query")


def rerank_pool(spark: SparkSession, d: str) -> DataFrame:
    """Dense hits of every question's first sub-query reordered by the share of the query's words that a passage has."""
    return _rounded(retrieval.rerank_pool(_scored_hits(spark, d).where("sub_idx = 0").drop("sub_idx")))


def rerank_pools(spark: SparkSession, d: str) -> DataFrame:
    """The same for every sub-query, each with its own pool."""
    return _rounded(retrieval.rerank_pool(_scored_hits(spark, d), by=("query_id", "sub_idx")))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_vecs")
    hits = F.when(F.col("query_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("query_id").cast("string")))
    results = q.withColumn("chunks", hits).withColumn("domain", F.when(F.col("query_id") % 5 != 0, F.col("domain")))
    made = cache.make_entries(results, F.lit(NOW).cast("timestamp"))
    age = F.make_dt_interval(hours=(F.col("query_id") * 17 % 400).cast("int"))
    return made.join(q.select("sub_query", "query_id"), "sub_query").withColumn("created_at", F.col("created_at") - age).drop("query_id")


def _lookups(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_vecs").withColumn("domain", F.when(F.col("query_id") % 5 != 0, F.col("domain")))
    same = q.select((F.col("query_id") * 2).alias("lookup_id"), F.concat(F.lit("  "), F.upper("sub_query"), F.lit(" ")).alias("sub_query"), "domain", "dense")
    other = q.select((F.col("query_id") * 2 + 1).alias("lookup_id"), F.concat("sub_query", F.lit(" bitte")).alias("sub_query"), "domain", "dense")
    return same.unionByName(other)


def _now() -> object:
    return F.lit(NOW).cast("timestamp")


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Cached results found exactly and by similarity."""
    return cache.lookup(_lookups(spark, d), _entries(spark, d), _now()).withColumn("similarity", F.round("similarity", 6))


def cache_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return cache.cleanup(_entries(spark, d), _now()).select("cache_id", "sub_query", "domain", "created_at")


def cache_invalidated(spark: SparkSession, d: str) -> DataFrame:
    return cache.invalidate(_entries(spark, d), "infra").select("cache_id", "sub_query", "domain")


def cache_totals(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return cache.totals(cache.count_hits(entries, cache.lookup(_lookups(spark, d), entries, _now())))


def _answer_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.top(table(spark, d, "candidates", "query_id", "point_id", "dense_score").where("dense_score is not null").distinct(), ["query_id"], 5, F.desc("dense_score"), F.col("point_id"))
    return hits.join(points(spark, d, "source_path", "header", "text").withColumnRenamed("source_path", "source"), "point_id")


def reordered(spark: SparkSession, d: str) -> DataFrame:
    return answer.reorder(_answer_hits(spark, d)).select("query_id", "point_id", "rank", "position")


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt of every query over its five best candidates."""
    asked = table(spark, d, "query_vecs").select("query_id", F.col("sub_query").alias("question"))
    made = answer.prompts(answer.reorder(_answer_hits(spark, d)), asked)
    return made.select("query_id", F.length("prompt").alias("n"), F.md5("prompt").alias("hash"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the built-in stand-in for a language model."""
    asked = table(spark, d, "query_vecs").select("query_id", F.col("sub_query").alias("question"))
    return answer.ask(answer.prompts(answer.reorder(_answer_hits(spark, d)), asked), asked, models.echo_generator)


def compact_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits cut to the units nearest to the question, 400 characters each."""
    hits = _answer_hits(spark, d).select("query_id", "point_id", "text")
    units = hits.select("query_id", "point_id", F.posexplode(units_of(F.col("text"))).alias("idx", "unit"))
    encoder = models.HashingEncoder()
    asked = models.encode(table(spark, d, "query_vecs").select("query_id", "sub_query"), "sub_query", encoder, "q").select("query_id", "q")
    scored = models.encode(units, "unit", encoder, "u").join(asked, "query_id").select("query_id", "point_id", "idx", "unit", F.round(F.coalesce(vx.cosine(F.col("q"), F.col("u")), F.lit(0.0)), 6).alias("similarity"))
    hit = ["query_id", "point_id"]
    return compress.join_units(compress.select_units(scored, hit, 400), units.groupBy(*hit).agg(F.count(F.lit(1)).alias("n")), hit)


QUERIES = {f.__name__: f for f in (
    dense_topk, dense_topk_domain, sparse_topk, hybrid_search, rrf_fusion, search_batch, find_related, rerank_pool, rerank_pools,
    cache_lookup, cache_cleanup, cache_invalidated, cache_totals, reordered, prompts, answers, compact_hits,
)}

_WITH = f"with {POINTS_SQL}, {QUERIES_SQL}"
_USABLE = "list_sum(list_transform(p.dense, lambda x: x * x)) > 0"


def _dense(n: int, domain: str = "(q.domain is null or q.domain = p.domain)") -> str:
    return f"""(select query_id, sub_idx, point_id, list_cosine_similarity(q.dense, p.dense) as score,
  row_number() over (partition by query_id, sub_idx order by round(list_cosine_similarity(q.dense, p.dense), 9) desc, point_id) as rank
  from asked q join points p on {domain} where {_USABLE} qualify rank <= {n})"""


def _sparse(n: int) -> str:
    return f"""(select query_id, sub_idx, point_id, sum(q.e.value::double * p.e.value::double) as score,
  row_number() over (partition by query_id, sub_idx order by round(sum(q.e.value::double * p.e.value::double), 9) desc, point_id) as rank
  from (select query_id, sub_idx, domain, unnest(map_entries(sparse)) as e from asked) q
  join (select point_id, domain, unnest(map_entries(sparse)) as e from points) p on q.e.key = p.e.key and (q.domain is null or q.domain = p.domain)
  group by 1, 2, 3 qualify rank <= {n})"""


_MAXSIM = "list_sum(list_transform(q.colbert, lambda x: list_max(list_transform(p.colbert, lambda y: list_cosine_similarity(x::double[], y::double[])))))"


def _hybrid(k: int) -> str:
    return f"""(select *, row_number() over (partition by query_id, sub_idx order by round(score, 9) desc, point_id) as rank from (
    select query_id, sub_idx, point_id, {_MAXSIM} as score
    from (select query_id, sub_idx, point_id from {_dense(100)} union select query_id, sub_idx, point_id from {_sparse(100)}) c
    join points p using (point_id) join asked q using (query_id, sub_idx)
    where len(p.colbert) > 0) qualify rank <= {k})"""


_ROUND = "round(score, 6) as score"
_RRF = """select query_id, point_id, round(s, 6) as score, row_number() over (partition by query_id order by s desc, point_id) as rank from (
  select query_id, point_id, list_reduce(list_prepend(0.0::double, list(1.0::double / (60 + rank) order by sub_idx)), lambda a, b: a + b) as s from {lists} group by 1, 2)"""
_CACHE = """
entries as (
  select query_id, sub_query, case when query_id % 5 <> 0 then coalesce(domain, '_global') else '_global' end as domain, dense::double[] as dense,
    trim(regexp_replace(lower(sub_query), '\\s+', ' ', 'g')) as norm, timestamptz '2025-07-01 00:00:00+00' - to_hours(query_id * 17 % 400) as created_at
  from query_vecs where query_id % 7 <> 0
), ided as (
  select *, regexp_replace(left(sha256('cache::' || domain || '::' || sub_query), 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as cache_id from entries
), lookups as (
  select query_id * 2 as lookup_id, trim(regexp_replace(lower('  ' || upper(sub_query) || ' '), '\\s+', ' ', 'g')) as norm, case when query_id % 5 <> 0 then coalesce(domain, '_global') else '_global' end as domain, dense::double[] as dense from query_vecs
  union all
  select query_id * 2 + 1, trim(regexp_replace(lower(sub_query || ' bitte'), '\\s+', ' ', 'g')), case when query_id % 5 <> 0 then coalesce(domain, '_global') else '_global' end, dense::double[] from query_vecs
), fresh as (select * from ided where created_at >= timestamptz '2025-07-01 00:00:00+00' - to_seconds(604800)),
exact as (select lookup_id, min(cache_id) as cache_id from lookups l join fresh e using (domain, norm) group by 1),
near as (
  select lookup_id, cache_id, list_cosine_similarity(l.dense, e.dense) as similarity from lookups l join fresh e using (domain)
  where lookup_id not in (select lookup_id from exact) and list_cosine_similarity(l.dense, e.dense) >= 0.95
  qualify row_number() over (partition by lookup_id order by round(list_cosine_similarity(l.dense, e.dense), 9) desc, cache_id) = 1
), hits as (
  select lookup_id, cache_id, 'exact' as stage, 1.0::double as similarity from exact union all select lookup_id, cache_id, 'semantic', round(similarity, 6) from near
)
"""
_HITS = """best as (
  select query_id, point_id, row_number() over (partition by query_id order by dense_score desc, point_id) as rank
  from (select distinct query_id, point_id, dense_score from candidates where dense_score is not null) qualify rank <= 5
), placed as (
  select *, case when count(*) over (partition by query_id) <= 2 or rank = 1 then rank when rank = 2 then count(*) over (partition by query_id) else rank - 1 end as position from best
)"""
_CLEAN = lambda c, n: f"replace(replace(left({c}, {n}), '=== ', '~~~ '), '---', '–––')"
_PROMPTS = f"""with {POINTS_SQL}, {_HITS}, parts as (
  select query_id, string_agg('[Abschnitt ' || position || ']' || case when coalesce(header, '') <> '' then ' ' || {_CLEAN('header', 200)} else '' end || ' (Quelle: ' || {_CLEAN('source_path', 200)} || ')' || E'\\n' ||
    {_CLEAN(r"regexp_replace(text, '^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')", 2000)}, E'\\n\\n---\\n\\n' order by position) as context
  from placed join points using (point_id) group by 1
), made as (
  select query_id, '{answer.INSTRUCTION}' || E'\\n\\n=== KONTEXT ===\\n\\n' || context || E'\\n\\n=== FRAGE ===\\n\\n' || {_CLEAN('sub_query', 500)} || E'\\n\\n=== ANTWORT ===' as prompt from parts join query_vecs using (query_id)
)"""
_WORDS = r"regexp_extract_all(lower({0}), '[\p{L}\p{N}_]+')"
#: The built-in encoder: a word's digest gives its coordinate and its sign.
_HASHED = lambda rows, keys, text: f"""(select {keys}, ('0x' || substr(h, 1, 2))::int % 64 as i, sum(case when substr(h, 15, 2) >= '80' then 1.0 else -1.0 end)::double as v
  from (select {keys}, md5(unnest({_WORDS.replace('{0}', text)})) as h from {rows}) group by all)"""  # noqa: E731
_COMPACT = rf"""chosen as (
  select query_id, point_id, row_number() over (partition by query_id order by dense_score desc, point_id) as n from (select distinct query_id, point_id, dense_score from candidates where dense_score is not null) qualify n <= 5
), chosen_units as (select query_id, point_id, idx, unit from chosen join units using (point_id)),
hashed as {_HASHED("chosen_units", "query_id, point_id, idx", "unit")},
asking as {_HASHED("query_vecs", "query_id", "sub_query")},
unit_norms as (select query_id, point_id, idx, sqrt(sum(v * v)) as l from hashed group by 1, 2, 3), query_norms as (select query_id, sqrt(sum(v * v)) as l from asking group by 1),
dots as (select h.query_id, point_id, idx, sum(h.v * a.v) as s from hashed h join asking a on a.query_id = h.query_id and a.i = h.i group by 1, 2, 3),
ranked as (
  select query_id, point_id, idx, unit, length(unit) as n, idx = 0 and starts_with(unit, '#') as head,
    row_number() over (partition by query_id, point_id order by round(coalesce(s / nullif(u.l * q.l, 0), 0), 6) desc, idx) as place, count(*) over (partition by query_id, point_id) as total
  from chosen_units left join dots using (query_id, point_id, idx) left join unit_norms u using (query_id, point_id, idx) left join query_norms q using (query_id)
), folded as (
  select query_id, point_id, idx, unit, total, place, true as kept, case when head then 0 else n end as used, not head as anything from ranked where place = 1
  union all
  select r.query_id, r.point_id, r.idx, r.unit, r.total, r.place, r.head or not f.anything or f.used + r.n <= 400,
    case when not r.head and (not f.anything or f.used + r.n <= 400) then f.used + r.n else f.used end, f.anything or not r.head
  from folded f join ranked r on r.query_id = f.query_id and r.point_id = f.point_id and r.place = f.place + 1
), shown as (
  select query_id, point_id, idx, total, case when idx <> coalesce(lag(idx) over (partition by query_id, point_id order by idx), -1) + 1 then E'[…]\n' else '' end || unit as line from folded where kept
)"""
ORACLES = {
    "compact_hits": rf"""with recursive {POINTS_SQL}, {UNITS_SQL}, {_COMPACT}
select query_id, point_id, string_agg(line, chr(10) order by idx) || case when max(idx) < any_value(total) - 1 then E'\n[…]' else '' end as compact from shown group by 1, 2""",
    "dense_topk": f"{_WITH} select query_id, sub_idx, point_id, {_ROUND}, rank from {_dense(10, 'true')}",
    "dense_topk_domain": f"{_WITH} select query_id, sub_idx, point_id, {_ROUND}, rank from {_dense(10)}",
    "sparse_topk": f"{_WITH} select query_id, sub_idx, point_id, {_ROUND}, rank from {_sparse(10)}",
    "hybrid_search": f"{_WITH} select query_id, sub_idx, point_id, {_ROUND}, rank from {_hybrid(10)}",
    "rrf_fusion": f"{_WITH} select * from ({_RRF.replace('{lists}', _dense(30))}) where rank <= 10",
    "search_batch": f"""{_WITH}, lists as (select * from {_hybrid(30)}), subs as (select query_id, count(*) as n from asked group by 1)
select query_id, point_id, round(score, 6) as score, rank from lists join subs using (query_id) where n = 1 and rank <= 10
union all select query_id, point_id, score, rank from ({_RRF.replace('{lists}', '(select l.* from lists l join subs using (query_id) where n > 1)')}) where rank <= 10""",
    "find_related": f"""{_WITH}, anchors as (
  select p.source_path, arg_min(p.dense, p.point_id) as dense from points p where {_USABLE} and {stem_sql('source_path')} in (select unnest(soll).notiz from gold_cases) group by 1
) select a.source_path, point_id, round(list_cosine_similarity(a.dense, p.dense), 6) as score,
  row_number() over (partition by a.source_path order by round(list_cosine_similarity(a.dense, p.dense), 9) desc, point_id) as rank
from anchors a join points p on a.source_path <> p.source_path where {_USABLE} qualify rank <= 5""",
    "rerank_pool": rf"""{_WITH}, hits as (select * from {_dense(15)} where sub_idx = 0), scored as (
  select h.query_id, h.point_id, h.score, h.rank, list_distinct(regexp_extract_all(lower(q.sub_query), '[\p{{L}}\p{{N}}_]+')) as a, list_distinct(regexp_extract_all(lower(p.text), '[\p{{L}}\p{{N}}_]+')) as b
  from hits h join points p using (point_id) join asked q using (query_id, sub_idx)
), valued as (select *, case when rank <= 10 then case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0 end end as r from scored)
select query_id, point_id, round(score, 6) as score, round(r, 6) as rerank_score, row_number() over (partition by query_id order by rank > 10, coalesce(r, 0) desc, rank) as rank from valued""",
    "rerank_pools": rf"""{_WITH}, hits as {_dense(15)}, scored as (
  select h.query_id, h.sub_idx, h.point_id, h.score, h.rank, list_distinct(regexp_extract_all(lower(q.sub_query), '[\p{{L}}\p{{N}}_]+')) as a, list_distinct(regexp_extract_all(lower(p.text), '[\p{{L}}\p{{N}}_]+')) as b
  from hits h join points p using (point_id) join asked q using (query_id, sub_idx)
), valued as (select *, case when rank <= 10 then case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0 end end as r from scored)
select query_id, sub_idx, point_id, round(score, 6) as score, round(r, 6) as rerank_score, row_number() over (partition by query_id, sub_idx order by rank > 10, coalesce(r, 0) desc, rank) as rank from valued""",
    "cache_lookup": f"with {_CACHE} select * from hits",
    "cache_cleanup": f"with {_CACHE} select cache_id, sub_query, domain, created_at from fresh",
    "cache_invalidated": f"with {_CACHE} select cache_id, sub_query, domain from ided where domain <> 'infra'",
    "cache_totals": f"with {_CACHE} select (select count(*) from ided) as entries, (select count(*) from hits) as hits",
    "reordered": f"with {_HITS} select query_id, point_id, rank, position from placed",
    "prompts": f"{_PROMPTS} select query_id, length(prompt)::int as n, md5(prompt) as hash from made",
    "answers": f"{_PROMPTS} select q.query_id, coalesce(length(prompt) || ' ' || left(sha256(prompt), 16), '{answer.NOTHING}') as answer from query_vecs q left join made using (query_id)",
}
