"""Queries over reports, the search log and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.operators import evaluation, reports
from mneme.plans.inputs import NOTES_SQL, POINTS_SQL, WHITE, notes, points, stem_sql
from mneme.storage import table
from mneme.streaming import streams

TODAY = "2025-07-01"
HEADING = "Offene Fragen"


def link_dead(spark: SparkSession, d: str) -> DataFrame:
    return reports.dead_links(notes(spark, d))


def link_orphans(spark: SparkSession, d: str) -> DataFrame:
    return reports.orphans(notes(spark, d))


def link_dead_ends(spark: SparkSession, d: str) -> DataFrame:
    return reports.dead_ends(notes(spark, d))


def link_most(spark: SparkSession, d: str) -> DataFrame:
    return reports.most_linked(notes(spark, d))


def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.graph_totals(notes(spark, d))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items below one heading of every point's text, some made urgent or dated by composition."""
    rows = points(spark, d, "text", "domain").withColumn(
        "text", F.replace("text", F.lit("- [ ] Das "), F.lit("- [ ] 🔴 **Das** (seit 2025-03-14) "))
    )
    return reports.items_from(rows, "point_id", "text", HEADING, "domain")


def open_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d)


def open_items_sorted(spark: SparkSession, d: str) -> DataFrame:
    return reports.ordered_items(_items(spark, d), F.lit(TODAY).cast("date")).select("position", "note", "marker", "since", "title", "age_days")


def item_totals(spark: SparkSession, d: str) -> DataFrame:
    return reports.item_totals(_items(spark, d))


def stats_latency(spark: SparkSession, d: str) -> DataFrame:
    """Latency figures of the last 256 events of the log."""
    return reports.latency_stats(table(spark, d, "events"), ["ts", "event_id"], "value")


def stats_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events", "event_type")
    return reports.runtime_totals(log, F.col("event_type").isin("view", "click"), F.col("event_type") == "click")


def log_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return streams.log_windows(table(spark, d, "events"), "ts", "1 hour")


def log_sliding(spark: SparkSession, d: str) -> DataFrame:
    return streams.log_windows(table(spark, d, "events"), "ts", "1 hour", "30 minutes")


def log_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.log_sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_cases")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Twenty hits per case at composed ranks: points of the notes it asks for or forbids, and its evidence for half of the cases."""
    cases = _cases(spark, d)
    p = points(spark, d, "source_path", "text").select(tx.file_stem(F.col("source_path")).alias("note"), F.col("point_id").alias("key"), "text")
    wanted = cases.select(F.col("id").alias("case_id"), F.explode(F.array_distinct(F.concat(F.transform("soll", lambda s: s["notiz"]), F.col("darf_nicht")))).alias("note"))
    chunks = wanted.join(p, "note")
    quoted = cases.where(F.length("frage") % 2 == 0).select(F.col("id").alias("case_id"), F.posexplode("soll").alias("n", "s")).select(
        "case_id", F.col("s.notiz").alias("note"), F.concat(F.lit("q"), F.col("n").cast("string")).alias("key"), F.concat(F.lit("Auszug:\n"), F.replace(F.col("s.beleg"), F.lit(". "), F.lit(".\n")), F.lit("\n")).alias("text")
    )
    order = F.sha2(F.concat("case_id", "note", "key"), 256)
    ranked = chunks.select("case_id", "note", "key", "text").unionByName(quoted).withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(order)))
    return ranked.where("rank <= 20").withColumn("score", F.lit(1.0) / F.col("rank")).drop("key")


def eval_variants(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.select_variants(_hits(spark, d)).select("variant", "case_id", "rank", "note", F.md5("text").alias("hash"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score_cases(evaluation.select_variants(_hits(spark, d)), _cases(spark, d))


def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    """The measurements of every case and variant."""
    s = _scored(spark, d)
    return s.withColumn("leaks", F.array_join("leaks", ",")).withColumn("best_score", F.round("best_score", 6)).withColumn("useful_share", F.round("useful_share", 6)).withColumn("coverage", F.round("coverage", 6))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Figures per variant, and per variant and type."""
    s = evaluation.summarize(_scored(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def eval_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("variant", "case_id", F.explode("leaks").alias("note"))


def eval_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose evidence no point of the note holds any more."""
    held = points(spark, d, "source_path", "text").select(tx.file_stem(F.col("source_path")).alias("note"), "text")
    return evaluation.orphaned_cases(_cases(spark, d), held)


def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    """What the narrower selection finds or loses against the wider one."""
    s = _scored(spark, d)
    return evaluation.compare_runs(s.where("variant = 'k10'"), s.where("variant = 'k3'")).select("case_id", "outcome")


def keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    words = _cases(spark, d).select(F.col("id").alias("case_id"), F.try_element_at(F.split("frage", " "), F.lit(2)).alias("keyword"))
    return evaluation.keyword_ranks(_hits(spark, d), words)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Raw judgements of several forms, made from the length of a case's question."""
    n = F.length("frage")
    def raw(labels: tuple[str, ...], shift: int):
        label = F.element_at(F.array(*[F.lit(x) for x in labels]), ((n + shift) % len(labels) + 1).cast("int"))
        return (
            F.when((n + shift) % 5 == 0, F.concat(F.lit("Urteil: ["), label, F.lit("] weil")))
            .when((n + shift) % 5 == 1, F.lit("kein Urteil"))
            .otherwise(F.to_json(F.struct(F.lower(label).alias("label"), F.lit("so").alias("begruendung"))))
        )
    rows = _cases(spark, d).select("id", "frage", *[raw(v, i).alias(k) for i, (k, v) in enumerate(evaluation.LABELS.items())])
    return rows.select("id", *[evaluation.judge_label(F.col(k), v).alias(k) for k, v in evaluation.LABELS.items()], F.length("frage").alias("latency_ms"))


def judge_labels(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.judge_summary(_judged(spark, d))


def judge_totals(spark: SparkSession, d: str) -> DataFrame:
    t = evaluation.judge_totals(_judged(spark, d))
    return t.withColumn("pass_rate", F.round("pass_rate", 6)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


def judge_stability(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent label per type of case, and its share."""
    rows = _judged(spark, d).join(_cases(spark, d).select("id", "typ"), "id")
    s = evaluation.stability(rows, "typ", "groundedness")
    return s.withColumn("stability", F.round("stability", 6))


QUERIES = {f.__name__: f for f in (
    link_dead, link_orphans, link_dead_ends, link_most, graph_totals, open_items, open_items_sorted, item_totals, stats_latency, stats_hit_rate,
    log_tumbling, log_sliding, log_sessions, eval_variants, eval_cases, eval_summary, eval_leaks, eval_orphans, eval_compare, keyword_rank,
    judge_labels, judge_summary, judge_totals, judge_stability,
)}

_EDGES = f"""{NOTES_SQL}, stems as (select source_path, {stem_sql('source_path')} as stem from note_rows),
edges as (select {stem_sql('source_path')} as source, unnest(links) as target from note_rows),
alive as (select * from edges where target in (select stem from stems)),
dead as (select * from edges where target is null or target not in (select stem from stems)),
orphans as (select stem from stems where stem not in (select target from alive)),
ends as (select {stem_sql('source_path')} as stem from note_rows where coalesce(len(links), 0) = 0)"""
_FLAT = lambda c: f"regexp_replace({c}, '{WHITE}+', ' ', 'g')"
_STRIP = lambda c: f"regexp_replace({c}, '^{WHITE}+|{WHITE}+$', '', 'g')"
_EVAL = f"""{POINTS_SQL}, wanted as (
  select distinct id as case_id, unnest(list_distinct(list_concat(list_transform(soll, lambda s: s.notiz), darf_nicht))) as note from gold_cases
), offered as (
  select case_id, w.note, point_id as key, text from wanted w join points p on {stem_sql('source_path')} = w.note
  union all
  select id, s.notiz, 'q' || n, E'Auszug:\\n' || replace(s.beleg, '. ', E'.\\n') || E'\\n' from (select id, frage, unnest(soll) as s, generate_subscripts(soll, 1) - 1 as n from gold_cases) where length(frage) % 2 = 0
), hits as (
  select case_id, note, text, row_number() over (partition by case_id order by sha256(case_id || note || key)) as rank from offered qualify rank <= 20
), variants as (select * from (values ('k10', 10, null), ('k5', 5, null), ('k3', 3, null), ('k5_max2', 5, 2), ('k5_max1', 5, 1)) v(variant, k, per_note)),
capped as (
  select variant, k, h.*, 1.0::double / rank as score from (select *, row_number() over (partition by case_id, note order by rank) as n from hits) h join variants on per_note is null or n <= per_note
), shown as (
  select variant, case_id, note, text, score, place as rank from (select *, row_number() over (partition by variant, case_id order by rank) as place from capped) where place <= k
), soll as (select id as case_id, s.notiz as note, {_FLAT('s.beleg')} as passage, n from (select id, unnest(soll) as s, generate_subscripts(soll, 1) as n from gold_cases)),
found as (select distinct variant, h.case_id, rank, n from shown h join soll s on s.case_id = h.case_id and s.note = h.note and contains({_FLAT('h.text')}, s.passage)),
per_passage as (select variant, case_id, min(rank) as passage_rank, count(distinct n) as covered from found group by 1, 2),
per_case as (
  select variant, h.case_id, min(h.rank) filter (list_contains(list_transform(g.soll, lambda s: s.notiz), note)) as note_rank,
    sum(length('## Result ' || h.rank || ' (score: ' || printf('%.2f', score) || ', source: /vault/notes/' || note || '.md)') + length({_STRIP('text')}) + 3) + 34 as chars,
    coalesce(sum(length(text)) filter (f.rank is not null), 0) as useful, sum(length(text)) as total, count(*) - count(distinct note) as repeats,
    coalesce(list_sort(list(distinct note) filter (list_contains(g.darf_nicht, note))), []) as leaks, arg_min(score, h.rank) as best_score
  from shown h join gold_cases g on g.id = h.case_id left join (select distinct variant, case_id, rank from found) f using (variant, case_id, rank) group by 1, 2
), scored as (
  select v.variant, g.id as case_id, g.typ, note_rank, passage_rank, case when len(g.soll) > 0 then coalesce(covered, 0) / len(g.soll) end as coverage,
    coalesce(chars, 34)::bigint as chars, case when total > 0 then useful / total else 0 end as useful_share, coalesce(repeats, 0) as repeats, coalesce(leaks, []) as leaks, best_score,
    g.typ not in ('negativ', 'geschuetzt') as m
  from gold_cases g cross join variants v left join per_case c on c.case_id = g.id and c.variant = v.variant left join per_passage p on p.case_id = g.id and p.variant = v.variant
)"""
_JUDGE = """raw as (
  select id, typ, length(frage) as n, ['RELEVANT', 'TEILWEISE_RELEVANT', 'IRRELEVANT'] as a, ['VOLLSTÄNDIG_BELEGT', 'TEILWEISE_BELEGT', 'NICHT_BELEGT', 'WIDERSPRÜCHLICH'] as b,
    ['BEANTWORTET', 'TEILWEISE_BEANTWORTET', 'NICHT_BEANTWORTET', 'ABLENKUNG'] as c from gold_cases
), judged as (
  select id, typ, case when n % 5 = 1 then 'PARSING_FAILED' else a[n % 3 + 1] end as context_relevance, case when (n + 1) % 5 = 1 then 'PARSING_FAILED' else b[(n + 1) % 4 + 1] end as groundedness,
    case when (n + 2) % 5 = 1 then 'PARSING_FAILED' else c[(n + 2) % 4 + 1] end as answer_relevance, n::int as latency_ms from raw
)"""
_FIRST = f"regexp_extract(line, '^[-*]{WHITE}+(?:[[][ xX][]]{WHITE}*)?(.*)$', 1)"
_ITEMS = rf"""{POINTS_SQL}, lines as (
  select point_id as note, domain, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i
  from (select point_id, domain, regexp_replace(replace(text, '- [ ] Das ', '- [ ] 🔴 **Das** (seit 2025-03-14) '), '\r\n|[\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') as t from points)
), fenced as (
  select *, regexp_matches(line, '^{WHITE}*```') as fence, sum(regexp_matches(line, '^{WHITE}*```')::int) over (partition by note order by i) as f from lines
), outside as (
  select note, domain, line, i, case when regexp_full_match(line, '(#{{1,6}}){WHITE}+(.*?){WHITE}*#*{WHITE}*') then length(regexp_extract(line, '^(#+)', 1)) else 0 end as depth,
    regexp_extract(line, '^#{{1,6}}{WHITE}+(.*?){WHITE}*#*{WHITE}*$', 1) as title from fenced where not fence and f % 2 = 0
), opened as (select note, min(i) as i0, arg_min(depth, i) as d0 from outside where depth > 0 and title = 'Offene Fragen' group by 1),
closed as (select o.note, min(x.i) as i1 from opened o join outside x on x.note = o.note and x.i > o.i0 and x.depth between 1 and o.d0 group by 1),
inside as (
  select x.*, regexp_full_match(line, '[-*]{WHITE}+(?:\[([ xX])\]{WHITE}*)?(.*)') as item from outside x join opened o on o.note = x.note and x.i > o.i0 left join closed c on c.note = x.note
  where (c.i1 is null or x.i < c.i1) and x.depth = 0
), counted as (select *, sum(item::int) over (partition by note order by i) as k from inside),
firsts as (select note, domain, k, i, lower(regexp_extract(line, '^[-*]{WHITE}+[[]([ xX])[]]', 1)) = 'x' as done, {_STRIP(_FIRST)} as first from counted where item),
rests as (select note, k, string_agg(' ' || {_STRIP('line')}, '' order by i) as rest from counted where not item and k > 0 and (line like '  %' or line like chr(9) || '%') and {_STRIP('line')} <> '' group by 1, 2),
marked as (
  select f.*, coalesce(rest, '') as rest, case when first like '🔴%' then '🔴' when first like '⚠️%' then '⚠️' else '' end as marker from firsts f left join rests using (note, k)
), heads as (select *, {_STRIP('substr(first, length(marker) + 1)')} as head from marked),
wholes as (select *, {_STRIP("head || ' ' || rest")} as whole, {_STRIP("regexp_replace(head, '^~~', '')")} as bare from heads),
items as (
  select note, domain, done, marker, nullif(regexp_extract(whole, '\(seit{WHITE}+(\d{{4}}-\d{{2}}-\d{{2}})\)', 1), '') as since,
    regexp_replace({_STRIP("case when regexp_extract(bare, '^[*][*](.+?)[*][*]', 1) <> '' then regexp_extract(bare, '^[*][*](.+?)[*][*]', 1) else left(bare, 70) end")}, '[.:~]+$', '') as title,
    {_STRIP(f"regexp_replace(whole, '[(]seit{WHITE}+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[)]', '', 'g')")} as text from wholes
)"""
ORACLES = {
    "link_dead": f"with {_EDGES} select source, target from dead",
    "link_orphans": f"with {_EDGES} select stem from orphans",
    "link_dead_ends": f"with {_EDGES} select stem from ends",
    "link_most": f"with {_EDGES} select target as stem, count(*) as inbound from alive group by 1 order by 2 desc, 1 limit 5",
    "graph_totals": f"with {_EDGES} select (select count(*) from note_rows) as notes, (select count(*) from edges) as links, (select count(*) from dead) as dead_links, (select count(*) from orphans) as orphans, (select count(*) from ends) as dead_ends",
    "open_items": f"with {_ITEMS} select * from items",
    "open_items_sorted": f"with {_ITEMS} select row_number() over (order by case marker when '🔴' then 0 when '⚠️' then 1 else 2 end, coalesce(since, '9999-99-99'), note, title, text) as position, note, marker, since, title, date_diff('day', try_cast(since as date), date '2025-07-01') as age_days from items where not done",
    "item_totals": f"with {_ITEMS} select count(*) filter (done) as done, count(*) filter (not done) as open, count(*) filter (not done and since is null) as undated from items",
    "stats_latency": "select quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, max(value) as max, count(*) as samples from (select value from events where value is not null order by ts desc, event_id desc limit 256)",
    "stats_hit_rate": "select count(*) filter (event_type in ('view', 'click')) as searches, count(*) filter (event_type = 'click') as cache_hits, round(count(*) filter (event_type = 'click') / count(*) filter (event_type in ('view', 'click')), 4) as cache_hit_rate from events",
    "log_tumbling": "select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as n, max(value) as value_max from events group by all",
    "log_sliding": """select s as window_start, s + interval '1 hour' as window_end, event_type, count(*) as n, max(value) as value_max
from (select event_type, value, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as s from events) group by all""",
    "log_sessions": """with marked as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval '30 minutes', true) as fresh from events window w as (partition by user_id order by ts)),
numbered as (select *, sum(fresh::int) over (partition by user_id order by ts rows unbounded preceding) as s from marked)
select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from numbered group by user_id, s""",
    "eval_variants": f"with {_EVAL} select variant, case_id, rank, note, md5(text) as hash from shown",
    "eval_cases": f"with {_EVAL} select variant, case_id, typ, note_rank, passage_rank, round(coverage, 6) as coverage, chars, round(useful_share, 6) as useful_share, repeats, array_to_string(leaks, ',') as leaks, round(best_score, 6) as best_score from scored",
    "eval_summary": f"""with {_EVAL} select variant, typ, count(*) as cases, round(count(*) filter (m and note_rank <= 1) / greatest(count(*) filter (m), 1), 6) as note_recall_1, round(count(*) filter (m and note_rank <= 99) / greatest(count(*) filter (m), 1), 6) as note_recall_k,
  round(count(*) filter (m and passage_rank <= 1) / greatest(count(*) filter (m), 1), 6) as passage_recall_1, round(count(*) filter (m and passage_rank <= 3) / greatest(count(*) filter (m), 1), 6) as passage_recall_3, round(count(*) filter (m and passage_rank <= 99) / greatest(count(*) filter (m), 1), 6) as passage_recall_k,
  round(coalesce(avg(coverage) filter (m), 0), 6) as coverage, round(coalesce(sum(1 / passage_rank) filter (m), 0) / greatest(count(*) filter (m), 1), 6) as mrr, median(chars)::double as chars_median,
  list_sort(list(chars))[1 + floor(0.9 * (count(*) - 1))::int] as chars_p90, round(median(chars) / 3.5)::bigint as tokens_median, round(coalesce(avg(useful_share) filter (m), 0), 6) as useful_share, round(avg(repeats), 6) as repeats_mean, count(*) filter (len(leaks) > 0) as leaks
from scored group by grouping sets ((variant), (variant, typ))""",
    "eval_leaks": f"with {_EVAL} select variant, case_id, unnest(leaks) as note from scored",
    "eval_orphans": f"with {POINTS_SQL} select distinct id from (select id, unnest(soll) as s from gold_cases) g where not exists (select 1 from points p where {stem_sql('p.source_path')} = s.notiz and contains({_FLAT('p.text')}, {_FLAT('s.beleg')}))",
    "eval_compare": f"with {_EVAL} select a.case_id, case when a.passage_rank is null and b.passage_rank is not null then 'found' when a.passage_rank is not null and b.passage_rank is null then 'lost' when a.passage_rank is null then 'neither' else 'both' end as outcome from scored a join scored b on a.case_id = b.case_id and a.variant = 'k10' and b.variant = 'k3'",
    "keyword_rank": f"with {_EVAL} select g.id as case_id, min(h.rank) filter (contains(lower(h.text), lower(string_split(g.frage, ' ')[2]))) as keyword_rank from gold_cases g left join hits h on h.case_id = g.id group by 1",
    "judge_labels": f"with {_JUDGE} select id, context_relevance, groundedness, answer_relevance, latency_ms from judged",
    "judge_summary": f"with {_JUDGE} select metric, label, count(*) as n from (select 'context_relevance' as metric, context_relevance as label from judged union all select 'groundedness', groundedness from judged union all select 'answer_relevance', answer_relevance from judged) group by all",
    "judge_totals": f"""with {_JUDGE} select count(*) as total_cases, round(count(*) filter (context_relevance = 'RELEVANT' and groundedness = 'VOLLSTÄNDIG_BELEGT' and answer_relevance = 'BEANTWORTET') / count(*), 6) as pass_rate,
  sum((context_relevance = 'PARSING_FAILED')::int + (groundedness = 'PARSING_FAILED')::int + (answer_relevance = 'PARSING_FAILED')::int) as parsing_failed, 0 as unavailable, round(avg(latency_ms), 6) as avg_latency_ms from judged""",
    "judge_stability": f"""with {_JUDGE}, counts as (select typ, groundedness as label, count(*) as n from judged group by all), tops as (select typ, max(n) as m, sum(n) as total from counts group by 1)
select typ, min(label) as label, round(any_value(m) / any_value(total), 6) as stability from counts join tops using (typ) where n = m group by 1""",
}
