"""Queries over the smaller operators: encodings, late chunks, single look-ups, evaluation parts, inputs read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mneme import models, schemas
from mneme.functions import text as tx
from mneme.operators import chunking, embedding, evaluation, index, reports, retrieval
from mneme.operators.vector_index import VectorIndex
from mneme.plans import reporting
from mneme.plans.inputs import NOTES_SQL, POINTS_SQL, QUERIES_SQL, UNITS_SQL, WHITE, notes, points, queries, stem_sql, strip_sql
from mneme.sources import files, markdown
from mneme.storage import materialize, scratch, table


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Properties of every note's first point."""
    return index.first_points(points(spark, d, "source_path", "run_id", "content_hash"), "point_id", "run_id", "content_hash")


def legacy_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Points whose ``source`` is a file name of a note with a newer run are gone."""
    p = points(spark, d, "source_path", "source", "run_id")
    current = p.groupBy("source_path").agg(F.max("run_id").alias("run_id")).where("source_path like '%7.md'")
    unique = current.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(tx.file_name(F.col("source_path"))))).where("n = 1").drop("n")
    return index.delete_legacy(p, unique).select("point_id", "source", "run_id")


def embedded_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every coordinate of the built-in dense encoding of the queries."""
    rows = models.encode(table(spark, d, "query_vecs", "query_id", "sub_query"), "sub_query", models.HashingEncoder())
    return rows.select("query_id", F.posexplode("dense").alias("i", "v")).where("v <> 0").select("query_id", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


def embedded_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The built-in sparse encoding of every document."""
    rows = models.encode_all(table(spark, d, "query_vecs", "query_id", "sub_query"), F.col("sub_query"))
    return rows.select("query_id", F.explode("sparse").alias("token", "w")).select("query_id", "token", F.round(F.col("w").cast("double"), 5).alias("w"))


def embedded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The built-in vectors of the words of every query, every coordinate."""
    rows = models.encode_all(table(spark, d, "query_vecs", "query_id", "sub_query"), F.col("sub_query"))
    each = rows.select("query_id", F.posexplode("colbert").alias("t", "vec")).select("query_id", "t", F.posexplode("vec").alias("i", "v"))
    return each.select("query_id", "t", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


def _late(spark: SparkSession, d: str, part: str) -> DataFrame:
    p = points(spark, d, "source_path", "chunk_id", "text").where("text is not null and source_path is not null and chunk_id is not null")
    return embedding.late_encodings(p, "point_id", "source_path", "chunk_id", F.col("text"), models.word_tokens, models.CHARACTER_TOKENS, limit=600, parts=(part,))


def late_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Dense vectors of the points, pooled from windows of consecutive chunks, every coordinate."""
    return _late(spark, d, "dense").select("point_id", F.posexplode("dense").alias("i", "v")).select("point_id", "i", F.round(F.col("v").cast("double"), 5).alias("v"))


def late_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Sparse weights of the points from the same windows: the greatest of every token id."""
    return _late(spark, d, "sparse").select("point_id", F.explode("sparse").alias("token", "w")).select("point_id", "token", F.round(F.col("w").cast("double"), 5).alias("w"))


def sparse_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Per point and token the greatest non-negative weight of three that are made from the stored one."""
    w = points(spark, d, "sparse").select(F.col("point_id").alias("chunk_id"), F.explode("sparse").alias("token_id", "w"))
    three = w.select("chunk_id", "token_id", F.explode(F.array(F.col("w").cast("double") - 1, -F.col("w").cast("double"), F.col("w").cast("double") / 2)).alias("weight"))
    return index.pool_sparse(three).withColumn("weight", F.round("weight", 6))


def pair_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a cross-encoder reads for every logged candidate, as hashes."""
    pairs = table(spark, d, "candidates", "query_id", "point_id").distinct()
    q = table(spark, d, "query_vecs", "query_id", "sub_query")
    rows = pairs.join(points(spark, d, "text", "source_path", "header"), "point_id").join(q, "query_id")
    return rows.select("query_id", "point_id", F.md5(tx.pair_text(F.col("sub_query"), tx.passage_text(F.col("source_path"), F.col("header"), F.col("text")))).alias("hash"))


def fused_hits(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits with their payload, and the metadata read back from its JSON."""
    p = points(spark, d, "domain", "source_path", "header", "text", "dense")
    fused = retrieval.rrf(retrieval.dense_topn(queries(spark, d), p, 20)).where("rank <= 5")
    hits = fused.join(p.drop("dense"), "point_id").withColumnRenamed("point_id", "id").withColumnRenamed("source_path", "source")
    rows = schemas.metadata(hits)
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    return rows.select(field("query_id").cast("long").alias("query_id"), field("rank").cast("int").alias("rank"), "id", "source", "header", field("domain").alias("domain"), F.md5("text").alias("hash"))


def fitting_sections(spark: SparkSession, d: str) -> DataFrame:
    """Whether every unit of every point is short enough for a chunk."""
    u = points(spark, d, "text").select("point_id", F.posexplode(chunking.units_of(F.col("text"))).alias("idx", "unit"))
    n = F.length("unit")
    fits = (n <= chunking.UNCOUNTED) | (models.CHARACTER_TOKENS.column(F.col("unit")) <= chunking.TOKENS)
    return u.select("point_id", "idx", fits.alias("fits"), models.CHARACTER_TOKENS.column(F.col("unit")).alias("tokens"))


def heading_hints(spark: SparkSession, d: str) -> DataFrame:
    """Short headings of the documents that look like a list of open items."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return reports.heading_hints(docs, "doc_id", "text", (reporting.HEADING,)).select(F.col("note").alias("doc_id"), "heading")


def item_bands(spark: SparkSession, d: str) -> DataFrame:
    """Open and undated items per band of urgency."""
    return reports.band_totals(reports.ordered_items(reporting._items(spark, d), F.lit(reporting.TODAY).cast("date")))


def related_notes(spark: SparkSession, d: str) -> DataFrame:
    """Three nearest points of other notes for every note."""
    p = points(spark, d, "domain", "source_path", "dense")
    anchors = retrieval.anchor_vectors(p).withColumn("query_id", F.xxhash64("source_path"))
    found = retrieval.related(anchors.select("query_id", "source_path", "dense"), p, 3)
    return found.join(anchors.select("query_id", "source_path"), "query_id").select("source_path", "point_id", F.round("score", 6).alias("score"), "rank")


def index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether an index that looks into a fifth of its lists finds nine tenths of the ten nearest points of all queries, and into all lists, every one."""
    p, q = points(spark, d, "domain", "dense"), queries(spark, d)
    held = VectorIndex(p)
    lists = len(held.centroids)
    want = materialize(retrieval.dense_topn(q, p, 10).select(*retrieval.KEYS, "point_id"), "want")

    def share(probes: int) -> DataFrame:
        return want.join(held.search(q, 10, probes).select(*retrieval.KEYS, "point_id", F.lit(1).alias("hit")), [*retrieval.KEYS, "point_id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("r"))

    some, all_ = share(max(1, -(-lists // 5))), share(lists)
    return some.select((F.col("r") >= 0.9).alias("reached")).crossJoin(all_.select((F.col("r") == 1).alias("exact")))  # one row each


def category_stats(spark: SparkSession, d: str) -> DataFrame:
    """Cases per type, and those with a question of even length, counted as passed."""
    rows = table(spark, d, "gold_cases").select(F.col("typ").alias("category"), (F.length("frage") % 2 == 0).alias("passed"))
    return evaluation.category_stats(rows)


def negative_scores(spark: SparkSession, d: str) -> DataFrame:
    """How high the best hits of cases without an answer score."""
    scores = evaluation.negative_scores(reporting._scored(spark, d))
    return scores.select("cases", *[F.round(c, 6).alias(c) for c in ("median", "least", "most")])


def rank_only(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of two words of each question among its hits, and whether the note of its evidence is near the top."""
    cases = table(spark, d, "gold_cases")
    word = lambda i: F.try_element_at(F.split("frage", " "), F.lit(i))
    asked = cases.select(F.col("id").alias("case_id"), word(2).alias("expected_keyword"), word(4).alias("expected_secondary_keyword"), F.get("soll", F.lit(0))["notiz"].alias("expected_source"))
    return evaluation.rank_only(reporting._hits(spark, d), asked)


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The three prompts of a judge for every case, its evidence as context and as answer, as hashes."""
    cases = table(spark, d, "gold_cases").where(F.size("soll") > 0)
    made = evaluation.triad_prompts(F.col("frage"), F.transform("soll", lambda s: s["beleg"]), F.get("soll", F.lit(0))["beleg"])
    return cases.select("id", *[F.md5(c).alias(m) for m, c in made.items()])


def gold_read(spark: SparkSession, d: str) -> DataFrame:
    """The gold set written as JSON lines and read back."""
    path = scratch(spark, "gold")
    table(spark, d, "gold_cases").select("id", "typ", "frage", "soll", F.when(F.size("darf_nicht") > 0, F.col("darf_nicht")).alias("darf_nicht")).write.json(path)
    rows = files.read_gold(spark, path)
    return rows.select("id", "typ", "frage", F.size("soll").alias("n"), F.array_join(F.transform("soll", lambda s: s["notiz"]), "|").alias("notes"), F.array_join("darf_nicht", "|").alias("barred"))


def parsed_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes composed with a header of properties and read back, links included."""
    n = notes(spark, d).select("source_path", "domain", "links", "content_hash")
    lines = [
        F.lit("---\ndomain: "), F.coalesce("domain", F.lit("")), F.lit("\nquelle: \"Heft  "), F.length("source_path").cast("string"), F.lit("\"\nupdated: "),
        F.when(F.length("source_path") % 3 == 0, "2025-01-02").otherwise("~"), F.lit("\nindexed: "), F.when(F.length("source_path") % 5 == 0, "false").otherwise("true"),
        F.lit("\n---\n# Titel\n"), F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " "), F.lit("\n"),
    ]
    rows = markdown.parse(n.select("source_path", F.concat(*lines).alias("markdown")))
    return rows.select("source_path", "domain", "quelle", "updated", "skip", F.col("error").isNotNull().alias("failed"), F.array_join(tx.wikilinks(F.col("body")), "¦").alias("links"))


QUERIES = {f.__name__: f for f in (
    point_lookup, legacy_deleted, embedded_queries, embedded_sparse, embedded_tokens, late_chunks, late_sparse, sparse_pooled, pair_texts, fused_hits, fitting_sections,
    heading_hints, item_bands, related_notes, index_recall, category_stats, negative_scores, rank_only, judge_prompts, gold_read, parsed_notes,
)}

_WITH = f"with {POINTS_SQL}"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{L}\p{N}_]+')"
_BYTE = lambda i: f"('0x' || substr(h, {2 * i + 1}, 2))::int"
_ASKED_WORDS = f"""words as (
  select query_id, generate_subscripts(w, 1) - 1 as t, md5(unnest(w)) as h from (select query_id, {_WORDS.replace('{0}', 'sub_query')} as w from query_vecs)
)"""
_VECTOR = "[" + ", ".join(f"{_BYTE(i)} - 127.5" for i in range(16)) + "]::double[]"
_POINT_WORDS = f"""words as (
  select point_id, md5(unnest({_WORDS.replace('{0}', 'text')})) as h from points where text is not null and source_path is not null and chunk_id is not null
)"""
_SANE = lambda c, n=2000: f"replace(replace(left({c}, {n}), '=== ', '~~~ '), '---', '–––')"
_CONTEXT = f"""(select string_agg('[Abschnitt ' || i || E']\\n' || {_SANE('b')}, E'\\n\\n' order by i) from (select unnest(list_transform(soll, lambda s: s.beleg)) as b, generate_subscripts(soll, 1) as i))"""


def _prompt(metric: str) -> str:
    task, fields = evaluation.TASKS[metric]
    head = f'{task}\n' + f'Erlaubt sind: {", ".join(evaluation.LABELS[metric])}.\nAntworte als JSON mit "label" und "begruendung".\n\n=== EINGABE ==='
    given = {"question": ("Frage", _SANE("frage")), "context": ("Kontext", _CONTEXT), "answer": ("Antwort", _SANE("soll[1].beleg"))}
    parts = [f"'{head}'"] + [f"E'\\n\\n{given[f][0]}:\\n' || {given[f][1]}" for f in fields] + ["E'\\n\\n=== BEWERTUNG ==='"]
    return f"md5({' || '.join(parts)}) as {metric}"


_LINK = f"{strip_sql('x')}"
ORACLES = {
    "point_lookup": f"{_WITH} select source_path, min(point_id) as point_id, arg_min(run_id, point_id) as run_id, arg_min(content_hash, point_id) as content_hash from (select p.*, c.content_hash from points p join (select point_id, any_value(content_hash) as content_hash from chunks group by 1) c using (point_id)) group by 1",
    "legacy_deleted": f"""{_WITH}, current as (
  select source_path, max(run_id) as run_id, regexp_extract(source_path, '([^/]*)$', 1) as name from points where source_path like '%7.md' group by source_path
), single as (select name, any_value(run_id) as run_id from current group by 1 having count(*) = 1)
select point_id, source, p.run_id from points p left join single o on o.name = p.source where o.run_id is null or p.run_id is not distinct from o.run_id""",
    "embedded_queries": f"""with {_ASKED_WORDS}, sums as (
  select query_id, {_BYTE(0)} % 64 as i, sum(case when substr(h, 15, 2) >= '80' then 1.0 else -1.0 end)::double as v from words group by all
), norms as (select query_id, sqrt(sum(v * v)) as l from sums group by 1)
select query_id, i, round((v / l)::float::double, 5) as v from sums join norms using (query_id) where v <> 0""",
    "embedded_sparse": f"""with {_ASKED_WORDS} select query_id, token, round((1 + ln(count(*)))::float::double, 5) as w
from (select query_id, ({_BYTE(0)} + 256 * {_BYTE(1)} + 65536 * {_BYTE(2)}::bigint) % 1048576 as token from words) group by 1, 2""",
    "embedded_tokens": f"""with {_ASKED_WORDS}, vectors as (select query_id, t, {_VECTOR} as x from words), unit as (select query_id, t, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) as l from vectors)
select query_id, t::int as t, (generate_subscripts(x, 1) - 1)::int as i, round((unnest(x) / l)::float::double, 5) as v from unit""",
    "late_chunks": f"""{_WITH}, {_POINT_WORDS}, sums as (
  select point_id, [{", ".join(f"sum({_BYTE(i)} - 127.5)" for i in range(16))}]::double[] as x from words group by 1
), unit as (select point_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) as l from sums)
select point_id, (generate_subscripts(x, 1) - 1)::int as i, round((unnest(x) / l)::float::double, 5) as v from unit""",
    "late_sparse": f"""{_WITH}, {_POINT_WORDS} select point_id, token, round(max(w)::float::double, 5) as w
from (select point_id, {_BYTE(0)} * 65536 + {_BYTE(1)} * 256 + {_BYTE(2)} as token, {_BYTE(3)} / 255 as w from words) group by 1, 2 having max(w) > 0""",
    "sparse_pooled": f"""{_WITH}, entries as (select point_id as chunk_id, unnest(map_entries(sparse)) as e from points)
select chunk_id, e.key as token_id, round(max(greatest(e.value::double - 1, -e.value::double, e.value::double / 2, 0)), 6) as weight from entries group by 1, 2 having max(greatest(e.value::double - 1, -e.value::double, e.value::double / 2, 0)) > 0""",
    "pair_texts": f"""{_WITH} select query_id, point_id, md5('<Instruct>: Find the passage of the notes that answers the question' || E'\\n<Query>: ' || sub_query || E'\\n<Document>: ' ||
  {stem_sql('source_path')} || case when coalesce(header, '') <> '' then ' › ' || header else '' end || E'\\n\\n' || text) as hash
from (select distinct query_id, point_id from candidates) join points using (point_id) join query_vecs q using (query_id)""",
    "fused_hits": f"""{_WITH}, {QUERIES_SQL}, lists as (
  select query_id, sub_idx, point_id, row_number() over (partition by query_id, sub_idx order by round(list_cosine_similarity(q.dense, p.dense), 9) desc, point_id) as rank
  from asked q join points p on q.domain is null or q.domain = p.domain where list_sum(list_transform(p.dense, lambda x: x * x)) > 0 qualify rank <= 20
), fused as (select query_id, point_id, row_number() over (partition by query_id order by s desc, point_id)::int as rank from (select query_id, point_id, sum(1.0::double / (60 + rank)) as s from lists group by 1, 2))
select query_id, rank, point_id as id, source_path as source, header, domain, md5(text) as hash from fused join points using (point_id) where rank <= 5""",
    "fitting_sections": f"{_WITH}, {UNITS_SQL} select point_id, idx, length(unit) <= 1869 or ceil(length(unit) / 3.1) <= 984 as fits, ceil(length(unit) / 3.1)::int as tokens from units",
    "heading_hints": rf"""with lines as (select doc_id, unnest(regexp_split_to_array(text, '\r?\n')) as line from documents where text is not null),
heads as (select doc_id, regexp_extract(line, '^#{{2,6}}\s+(.*?)\s*#*\s*$', 1) as heading from lines)
select doc_id, heading from heads where heading <> '' and len(regexp_split_to_array(heading, '\s+')) <= 4 and heading <> 'Offene Fragen' and regexp_matches(heading, '(?i)(offen|to-?do|n[aäÄ]chste (konkrete )?schritte|idee)')""",
    "item_bands": f"""with {reporting._ITEMS} select band, ['DRINGEND', 'WICHTIG', 'KANN WARTEN'][band + 1] as name, count(*) as open, count(*) filter (since is null) as undated
from (select case marker when '🔴' then 0 when '⚠️' then 1 else 2 end as band, since from items where not done) group by 1""",
    "related_notes": f"""{_WITH}, usable as (select point_id, source_path, dense::double[64] as v from points where list_sum(list_transform(dense, lambda x: x * x)) > 0),
anchors as (select source_path, arg_min(v, point_id) as v from usable group by 1)
select source_path, point_id, round(score, 6) as score, rank from (
  select a.source_path, p.point_id, array_cosine_similarity(a.v, p.v) as score, row_number() over (partition by a.source_path order by round(array_cosine_similarity(a.v, p.v), 9) desc, p.point_id) as rank
  from anchors a join usable p on p.source_path is distinct from a.source_path) where rank <= 3""",
    "index_recall": "select true as reached, true as exact",
    "category_stats": "select typ as category, count(*) as cases, count(*) filter (length(frage) % 2 = 0) as passed from gold_cases group by 1",
    "negative_scores": f"with {reporting._EVAL} select count(*) as cases, round(median(best_score), 6) as median, round(min(best_score), 6) as least, round(max(best_score), 6) as most from scored where variant = 'k10' and typ = 'negativ' and best_score is not null",
    "rank_only": f"""with {reporting._EVAL}, wanted_words as (select id as case_id, string_split(frage, ' ')[2] as a, string_split(frage, ' ')[4] as b, soll[1].notiz as note from gold_cases)
select w.case_id, min(rank) filter (contains(lower(h.text), lower(a))) as keyword_rank, min(rank) filter (contains(lower(h.text), lower(b))) as secondary_rank, coalesce(bool_or(rank <= 3 and contains(h.note, w.note)), false) as source_in_top3
from wanted_words w left join hits h using (case_id) group by 1""",
    "judge_prompts": f"select id, {', '.join(_prompt(m) for m in evaluation.TASKS)} from gold_cases where len(soll) > 0",
    "gold_read": "select id, typ, frage, len(soll)::int as n, array_to_string(list_transform(soll, lambda s: s.notiz), '|') as notes, array_to_string(darf_nicht, '|') as barred from gold_cases",
    "parsed_notes": rf"""with {NOTES_SQL}, rows as (
  select source_path, {strip_sql("coalesce(domain, '')")} as dom, length(source_path) as n, coalesce(links, []) as links from note_rows
), texts as (
  select *, regexp_replace(array_to_string(list_transform(list_filter(links, lambda x: x is not null), lambda x: '[[' || x || ']]'), ' '), '(?s:```.*?```)|`[^`\n]*`', '', 'g') as t from rows
)
select source_path, case when dom not in ('', 'null', '~') then dom end as domain, 'Heft ' || n as quelle, case when n % 3 = 0 then '2025-01-02' end as updated, n % 5 = 0 as skip, n % 5 <> 0 and dom in ('', 'null', '~') as failed,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\[\[([^\]|#]+?)(?:[#|][^\]]*)?\]\]', 1), lambda x: {_LINK}), lambda x: x <> ''))), '¦') as links from texts""",
}
