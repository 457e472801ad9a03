"""Queries of the training-data operators, with SQL where whole tables allow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mneme.llm import leaks, markup, neardup, neighbours, pack, rankfuse, sentences, split
from mneme.storage import table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the oversized points, each point once."""
    chunks = table(spark, d, "chunks", "point_id", "source_path", "header", "section_id", "text")
    over = chunks.where(F.length("text") > split.LIMIT).dropDuplicates(["point_id"])
    return split.split(over, ["point_id"], ["header", "section_id"], only_oversized=True)


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of every oversized point are short enough and overlap by no more than they may, and the hash of what they make without the overlaps."""
    pieces = p1_pieces(spark, d)
    order = Window.partitionBy("point_id").orderBy("piece")
    placed = pieces.withColumn("repeated", F.coalesce(F.lag("end_char").over(order) - F.col("start_char"), F.lit(0)))
    good = (F.length("piece_text") <= split.LIMIT) & F.col("repeated").between(0, split.OVERLAP) & ((F.col("piece") == 1) | (F.col("repeated") > 0))
    fresh = F.struct("piece", F.expr("substring(piece_text, repeated + 1)").alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(fresh)), lambda x: x["t"]), "")
    return placed.groupBy("point_id").agg(F.every(good).alias("within"), F.md5(whole).alias("hash"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where((F.col("piece") == 1) & (F.col("n_pieces") > 1)).select("point_id")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Points with the folder of their note as host."""
    points = table(spark, d, "chunks", "point_id", "source_path", "text")
    return points.withColumn("host", F.regexp_extract("source_path", r"^/?([^/]*/[^/]*)/", 1))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.residue(_marked(spark, d), "point_id", "host")
    return found.select(F.col("key").alias("point_id"), "kind").distinct()


def p4_wrappers(spark: SparkSession, d: str) -> DataFrame:
    """The wrappers of every note folder."""
    return markup.wrappers(markup.block_streams(_marked(spark, d), "point_id", "host"))


def p4_unmarked(spark: SparkSession, d: str) -> DataFrame:
    """The points whose text holds no markup, with the hash of their clean text."""
    return p4_clean(spark, d).where((F.size("kinds") == 0) & F.col("text").isNotNull()).select("point_id", F.md5("clean").alias("hash"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of every point."""
    return markup.clean_texts(_marked(spark, d), "point_id", "host")


_SCORES = ["dense_score", "sparse_score", "colbert_score"]


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return rankfuse.aggregate_ranks(table(spark, d, "candidates"), "query_id", "point_id", _SCORES, "logged_at")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("query_id", "point_id", F.round("rho", 9).alias("rho"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rankfuse.best(_ranked(spark, d), "query_id", "point_id", 5).select("query_id", "point_id")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "chunks", "point_id", "source_path", "dense")
    return neighbours.nearest(points, "point_id", "source_path", "dense", k=5, least=0.90)


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).withColumn("similarity", F.round("similarity", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).select(
        F.least("point_id", "neighbour").alias("point_a"), F.greatest("point_id", "neighbour").alias("point_b")
    ).distinct()


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest points of other notes for every usable point, however far they are."""
    points = table(spark, d, "chunks", "point_id", "source_path", "dense")
    return neighbours.exact(points, F.lit(True), "point_id", "source_path", "dense", 5).withColumn("similarity", F.round("similarity", 6))


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest points of every point whose hash is divisible by 50, against all points, however far they are."""
    points = table(spark, d, "chunks", "point_id", "source_path", "dense")
    asked = F.pmod(F.xxhash64("point_id"), F.lit(50)) == 0
    return neighbours.exact(points, asked, "point_id", "source_path", "dense", 5).withColumn("similarity", F.round("similarity", 6))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, d, "chunks", "point_id", "source_path", "text")
    return neardup.near_duplicates(points, "point_id", "source_path", "text", least=0.5, least_words=20, run=3)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.every_pair(*_near(spark, d)).select(F.col("a").alias("point_a"), F.col("b").alias("point_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every point with its group of near copies and its number of links to different texts."""
    return neardup.groups_of(*_near(spark, d)).withColumnRenamed("key", "point_id").withColumnRenamed("owner", "source_path")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(table(spark, d, "documents", "doc_id", "text"), "doc_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("container is not null").groupBy("container").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens")
    )


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers hold everything, none too much, in at most a hundredth more of them than needed: one row."""
    packed = _packed(spark, d)
    held = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("t"))
    items = packed.agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.expr("n_pieces > 1 and piece = 1")).alias("cut"))
    made = held.agg(F.count_if(F.col("t") > pack.CAPACITY).alias("too_full"), F.sum("t").alias("held"), (F.count(F.lit(1)) <= F.ceil(F.sum("t") / pack.CAPACITY) * 1.01 + 1).alias("close"))
    return items.crossJoin(made)  # one row each


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1 and piece = 1").select("doc_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "gold_cases", "id", "soll").select("id", F.explode("soll.beleg").alias("beleg"))
    return leaks.leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", cases, "id", "beleg").withColumnRenamed("case", "case_id").withColumnRenamed("key", "doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its kind, the share of the passage in order and of its figures."""
    return _leaks(spark, d)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("verbatim").select("case_id", "doc_id")


def _sentences(spark: SparkSession, d: str, **options) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "fmt")
    return sentences.sentences(docs, "doc_id", "text", F.col("fmt") == "note", **options)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d, only=F.col("fmt").isin("plain", "wrapped"), with_text=False).select("doc_id", "end_char")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document, Markdown ones included."""
    return _sentences(spark, d)


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rejoined": p1_rejoined,
    "p2_found": p2_found,
    "p2_ranking": p2_ranking,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p3_nearest": p3_nearest,
    "p3_exact": p3_exact,
    "p4_found": p4_found,
    "p4_wrappers": p4_wrappers,
    "p4_clean": p4_clean,
    "p4_unmarked": p4_unmarked,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_totals": p8_totals,
    "p10_found": p10_found,
    "p10_sentences": p10_sentences,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
}

_RHO = """
with latest as (
  select query_id, point_id, dense_score d, sparse_score s, colbert_score c from candidates
  where query_id is not null and point_id is not null
  qualify row_number() over (partition by query_id, point_id order by logged_at desc, dense_score desc) = 1
), ranks as (
  select query_id, point_id, count(*) over (partition by query_id) as n,
    case when d is null then null else count(d) over (partition by query_id order by d desc range between unbounded preceding and current row) end as rd,
    case when s is null then null else count(s) over (partition by query_id order by s desc nulls last range between unbounded preceding and current row) end as rs,
    case when c is null then null else count(c) over (partition by query_id order by c desc nulls last range between unbounded preceding and current row) end as rc
  from latest
), normal as (
  select query_id, point_id, list_sort([coalesce(rd / n, 1), coalesce(rs / n, 1), coalesce(rc / n, 1)]) as r from ranks
), scored as (
  select query_id, point_id, (r[1] + r[2] + r[3]) / 3 as mean_rank,
    least(1, 3 * least(1, 1 - (1 - r[1]) ** 3, 3 * r[2] ** 2 * (1 - r[2]) + r[2] ** 3, r[3] ** 3)) as rho from normal
)
"""
_NEAR = """
with points as (
  select point_id, any_value(source_path) as source_path, any_value(dense)::double[64] as v from chunks
  where len(dense) = 64 and list_sum(list_transform(dense, lambda x: abs(x))) > 0 group by point_id
), pairs as (
  select a.point_id, a.source_path, b.point_id as neighbour, array_cosine_similarity(a.v, b.v) as similarity
  from points a join points b on a.source_path is distinct from b.source_path
), best as (
  select point_id, neighbour, similarity, row_number() over (partition by point_id order by similarity desc, neighbour) as position
  from pairs where similarity >= 0.9 qualify position <= 5
)
"""
_WORD_RUNS = r"""
with points as (
  select point_id, any_value(source_path) as source_path, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') as w
  from chunks where text is not null group by point_id
), runs as (
  select distinct point_id, source_path, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as run
  from (select *, unnest(range(1, len(w) - 1)) as i from points where len(w) >= 20)
), sizes as (select point_id, count(*) as n from runs group by 1),
rare as (
  select * from (select *, row_number() over (partition by point_id order by df, run) as k from (select *, count(*) over (partition by run) as df from runs))
  join sizes using (point_id) where k <= n - ceil(n / 2) + 1
), maybe as (
  select distinct a.point_id as a, b.point_id as b from rare a join rare b on a.run = b.run and a.point_id < b.point_id and a.source_path is distinct from b.source_path
), shared as (
  select a, b, count(*) as n from maybe join runs x on x.point_id = a join runs y on y.point_id = b and y.run = x.run group by 1, 2
)
select a as point_a, b as point_b from shared join sizes s on s.point_id = a join sizes t on t.point_id = b
where shared.n * 2 >= s.n + t.n - shared.n
"""
_GROUPS = r"""
with recursive points as (
  select point_id, any_value(source_path) as source_path, regexp_extract_all(lower(any_value(text)), '[\p{L}\p{N}]+') as w
  from chunks where text is not null group by point_id
), long as (
  select point_id, source_path, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as s from points where len(w) >= 20
), members as (select point_id, source_path, md5(s::varchar) as cls from long),
runs as (select cls, unnest(s) as run from (select md5(s::varchar) as cls, any_value(s) as s from long group by 1)),
sizes as (select cls, count(*) as n from runs group by 1),
rare as (
  select * from (select *, row_number() over (partition by cls order by df, run) as k from (select *, count(*) over (partition by run) as df from runs))
  join sizes using (cls) where k <= n - ceil(n / 2) + 1
), maybe as (select distinct a.cls as a, b.cls as b from rare a join rare b on a.run = b.run and a.cls < b.cls),
shared as (select a, b, count(*) as n from maybe join runs x on x.cls = a join runs y on y.cls = b and y.run = x.run group by 1, 2),
links as (select a, b from shared join sizes s on s.cls = a join sizes t on t.cls = b where shared.n * 2 >= s.n + t.n - shared.n),
edges as (select a as x, b as y from links union all select b, a from links),
reach as (select cls as x, cls as y from sizes union select r.x, e.y from reach r join edges e on e.x = r.y),
least as (select x, min(point_id) as "group" from reach join members on cls = y group by 1),
degree as (select x, count(*) as n from edges group by 1)
select point_id, source_path, "group", coalesce(n, 0) as n_links from members join least l on l.x = cls left join degree d on d.x = cls
"""
# fixed values: the elements of HTML, longer names first where one begins with another
_TAG = (
    "abbr|acronym|address|applet|area|article|aside|audio|a|basefont|base|bdi|bdo|big|blink|blockquote|body|br|button|b|canvas|caption|center|cite|code|colgroup|col|"
    "datalist|data|dd|del|details|dfn|dialog|dir|div|dl|dt|embed|em|fieldset|figcaption|figure|font|footer|form|frameset|frame|h1|h2|h3|h4|h5|h6|header|head|hgroup|hr|html|"
    "iframe|img|input|ins|i|kbd|label|legend|link|li|main|map|mark|marquee|math|menu|meta|meter|nav|nobr|noframes|noscript|object|ol|optgroup|option|output|param|picture|pre|"
    "progress|p|q|rp|rt|ruby|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|s|table|tbody|td|template|textarea|tfoot|thead|th|time|title|"
    "track|tr|tt|ul|u|var|video|wbr"
)
_MARKUP = rf"""
with plain as (
  select point_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)(<(?:pre|code)[^<>]*>)[^<]*', '\1', 'g'), '`+[^`\n]+`+', ' ', 'g'), '[A-Za-z]:\\[^\s<>|"]*', ' ', 'g') as t from (
    select point_id, regexp_replace(regexp_replace(any_value(text), '(?ms)^[ \t>]*```.*?(?:^[ \t>]*```[ \t]*$|\z)', ' ', 'g'), '(?ms)^[ \t>]*~~~.*?(?:^[ \t>]*~~~[ \t]*$|\z)', ' ', 'g') as t
    from chunks where text is not null group by point_id)
)
select point_id, 'html' as kind from plain where regexp_matches(t, '(?i)</?({_TAG})(?:\s+[a-z_:@][\w:.-]*(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''=<>`]+))?)*\s*/?>|<!--|&(?:#[0-9]+|#x[0-9a-f]+|amp|lt|gt|quot|apos|nbsp|ndash|mdash|hellip|auml|ouml|uuml|szlig|euro|copy|rarr);')
union all
select point_id, 'wiki' from plain where regexp_matches(t, '(?m)''''[^''\s][^''\n]*''''|^={{2}}[ \t]+[^=\n]+[ \t]+={{2}}[ \t]*\r?$|^={{3,6}}[ \t]*[^=\n]+={{3,6}}[ \t]*\r?$|\{{\{{\s*[#:]?\pL[^{{}}]*\}}\}}|^[ \t:]*\{{\||\[\[\s*:?(?i:file|image|media|category|datei|bild|kategorie|fichier|catégorie|archivo|imagen|categoría)\s*:|__(?:NO)?TOC__|__(?:NOEDITSECTION|NOINDEX|INDEX|HIDDENCAT)__')
union all
select point_id, 'latex' from plain where regexp_matches(t, '(?s)\\(?:begin|end)\{{|\\[A-Za-z]+\*?\{{|\$\$[^$]+\$\$|\\\[[^\]]*[\\^_=+][^\]]*\\\]|\\\([^)]+\\\)|(?:^|[^\\\w$])\$[^\s$](?:[^$\n]*[^\s\\$])?\$(?:[^\w$]|$)|\\(?:item|alpha|beta|le|pi|sum)[^A-Za-z\\]')
"""
ORACLES = {
    "p4_found": _MARKUP,
    "p4_unmarked": f"with found as ({_MARKUP}) select point_id, md5(any_value(text)) as hash from chunks where text is not null and point_id not in (select point_id from found) group by point_id",
    "p1_rejoined": r"select point_id, true as within, md5(any_value(trim(text, E' \t\r\n'))) as hash from chunks where length(trim(text, E' \t\r\n')) > 2800 group by 1",
    "p3_found": _NEAR + "select distinct least(point_id, neighbour) as point_a, greatest(point_id, neighbour) as point_b from best",
    "p3_neighbours": _NEAR + "select point_id, neighbour, round(similarity, 6) as similarity, position from best",
    "p3_nearest": _NEAR.replace("where similarity >= 0.9 ", "") + "select point_id, neighbour, round(similarity, 6) as similarity, position from best",
    "p6_found": _WORD_RUNS,
    "p6_groups": _GROUPS,
    "p1_found": r"select distinct point_id from chunks where length(trim(text, E' \t\r\n')) > 2800",
    "p2_ranking": _RHO + "select query_id, point_id, round(rho, 9) as rho from scored",
    "p2_found": _RHO
    + """select query_id, point_id from scored
qualify row_number() over (partition by query_id order by round(rho, 12), round(mean_rank, 12), point_id) <= 5""",
    "p9_found": r"""
with cases as (select id as case_id, regexp_replace(lower(b.beleg), '[^\p{L}\p{N}]', '', 'g') as p from (select id, unnest(soll) as b from gold_cases)),
docs as (select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') as t from documents where text is not null),
runs as (select distinct case_id, p[i:i + 49] as run from (select *, unnest(range(1, len(p) - 48)) as i from cases where len(p) >= 50))
select distinct case_id, doc_id from (select doc_id, t[i:i + 49] as run from (select *, unnest(range(1, len(t) - 48)) as i from docs where len(t) >= 50))
join runs using (run)""",
    "p8_totals": """select sum(strlen(coalesce(text, ''))) as tokens, count(distinct doc_id) as documents, count(distinct doc_id) filter (strlen(text) > 8192) as cut,
  0 as too_full, sum(strlen(coalesce(text, ''))) as held, true as close from documents""",
    "p8_found": "select doc_id from documents where strlen(text) > 8192",
}
