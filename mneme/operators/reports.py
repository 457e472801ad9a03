"""Corpus reports: link graph, open items, runtime figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.functions.stats import nearest_rank, rate
from mneme.operators.chunking import items_of
from mneme.operators.ranking import row_numbers

#: Urgency marks in their order; the last band has none.
BANDS = (("🔴", "DRINGEND"), ("⚠️", "WICHTIG"), ("", "KANN WARTEN"))
#: Samples that the latency figures look back on.
LATENCY_WINDOW = 256


def link_edges(notes: DataFrame) -> DataFrame:
    """``source, target, alive`` per note and link, by file stem; a link to an existing stem is alive."""
    stems = notes.select(tx.file_stem(F.col("source_path")).alias("target")).distinct().withColumn("alive", F.lit(True))
    edges = notes.select(tx.file_stem(F.col("source_path")).alias("source"), F.explode("links").alias("target"))
    return edges.join(stems, "target", "left").select("source", "target", F.coalesce("alive", F.lit(False)).alias("alive"))


def dead_links(notes: DataFrame) -> DataFrame:
    return link_edges(notes).where("not alive").select("source", "target")


def orphans(notes: DataFrame) -> DataFrame:
    """Stems of notes that no link points to; a link to oneself counts."""
    linked = link_edges(notes).where("alive").select(F.col("target").alias("stem")).distinct()
    return notes.select(tx.file_stem(F.col("source_path")).alias("stem")).join(linked, "stem", "left_anti")


def dead_ends(notes: DataFrame) -> DataFrame:
    return notes.where(F.coalesce(F.size("links"), F.lit(0)) <= 0).select(tx.file_stem(F.col("source_path")).alias("stem"))


def most_linked(notes: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` stems with most inbound links; ties go to the smaller name."""
    return link_edges(notes).where("alive").groupBy(F.col("target").alias("stem")).agg(F.count(F.lit(1)).alias("inbound")).orderBy(F.desc("inbound"), "stem").limit(k)


def graph_totals(notes: DataFrame) -> DataFrame:
    edges = link_edges(notes)
    one = notes.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum(F.greatest(F.size("links"), F.lit(0))), F.lit(0)).alias("links"))
    dead = edges.where("not alive").agg(F.count(F.lit(1)).alias("dead_links"))
    alone = orphans(notes).agg(F.count(F.lit(1)).alias("orphans"))
    ends = dead_ends(notes).agg(F.count(F.lit(1)).alias("dead_ends"))
    return one.crossJoin(dead).crossJoin(alone).crossJoin(ends)  # one row each


#: Marker, struck out or not, title in bold, plain beginning: what an item's first line holds, in this order.
_LEAD = rf"(?U)^({BANDS[0][0]}|{BANDS[1][0]})?\s*(?:~~)?\s*(?:\*\*(.+?)\*\*)?(.{{0,70}})"
_SINCE = r"(?U)\(seit\s+(\d{4}-\d{2}-\d{2})\)"


def items_from(texts: DataFrame, note: str, text: str, heading: str, domain: str | None = None) -> DataFrame:
    """Items below ``heading``: ``note, domain, done, marker, since, title, text``."""
    i = F.col("i")
    lead = [F.regexp_extract(i["first"], _LEAD, n) for n in (1, 2, 3)]
    body = tx.strip(F.regexp_replace(F.concat(i["first"], F.lit(" "), i["rest"]), rf"^(?:{BANDS[0][0]}|{BANDS[1][0]})", ""))
    return texts.select(
        F.col(note).alias("note"), (F.col(domain) if domain else F.lit(None).cast("string")).alias("domain"), F.explode(items_of(F.col(text), heading)).alias("i")
    ).select(
        "note", "domain", i["done"].alias("done"), lead[0].alias("marker"), F.nullif(F.regexp_extract(body, _SINCE, 1), F.lit("")).alias("since"),
        F.regexp_replace(tx.strip(F.concat(lead[1], F.when(lead[1] == "", lead[2]).otherwise(""))), r"[.:~]+$", "").alias("title"),
        tx.strip(F.regexp_replace(body, _SINCE, "")).alias("text"),
    )


def ordered_items(items: DataFrame, today: Column) -> DataFrame:
    """Open items with their age and ``position``: by urgency, oldest first, undated last, then note and title."""
    band = F.when(F.col("marker") == BANDS[0][0], 0).when(F.col("marker") == BANDS[1][0], 1).otherwise(2)
    opened = items.where("not done").withColumn("band", band).withColumn("age_days", tx.age_days(F.col("since"), today))
    return row_numbers(opened, [F.col("band"), F.asc_nulls_last("since"), F.col("note"), F.col("title"), F.col("text")], "position")


def band_totals(ordered: DataFrame) -> DataFrame:
    """Open items, and the undated among them, per band of urgency: ``band, name, open, undated``; bands without items are left out."""
    name = F.element_at(F.array(*[F.lit(n) for _, n in BANDS]), F.col("band") + 1)
    return ordered.groupBy("band").agg(F.count(F.lit(1)).alias("open"), F.count_if(F.col("since").isNull()).alias("undated")).withColumn("name", name)


def item_totals(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open"), F.count_if(~F.col("done") & F.col("since").isNull()).alias("undated"))


def latency_stats(log: DataFrame, order: list[str], latency: str, window: int = LATENCY_WINDOW) -> DataFrame:
    """p50, p95, greatest and number of the last ``window`` latencies; nulls where there are none."""
    last = log.where(F.col(latency).isNotNull()).orderBy(*[F.desc(c) for c in order]).limit(window)
    return last.agg(nearest_rank(F.col(latency), 50).alias("p50"), nearest_rank(F.col(latency), 95).alias("p95"), F.max(latency).alias("max"), F.count(F.lit(1)).alias("samples"))


def runtime_totals(log: DataFrame, searched: Column, hit: Column) -> DataFrame:
    counted = log.agg(F.count_if(searched).alias("searches"), F.count_if(searched & hit).alias("cache_hits"))
    return counted.withColumn("cache_hit_rate", rate(F.col("cache_hits"), F.col("searches")))


def heading_hints(texts: DataFrame, note: str, text: str, known: tuple[str, ...]) -> DataFrame:
    """Short headings of level 2 and deeper that look like a list of open items, but are none of the known ones."""
    lines = texts.select(F.col(note).alias("note"), F.explode(F.split(text, r"\r?\n")).alias("line"))
    head = F.regexp_extract("line", r"^#{2,6}\s+(.*?)\s*#*\s*$", 1)
    # fixed value: what such headings hold
    like = r"(?iu)(offen|to-?do|n[aä]chste (konkrete )?schritte|idee)"
    return lines.select("note", head.alias("heading")).where((F.col("heading") != "") & (F.size(F.split("heading", r"\s+")) <= 4) & ~F.col("heading").isin(*known) & F.col("heading").rlike(like))


def items_text(ordered: DataFrame, markdown: bool = False) -> str:
    """The list of open items for reading, by urgency; as a note it is marked so that it is never indexed."""
    rows = ordered.orderBy("position").collect()
    out = ["---\nindexed: false\n---\n"] if markdown else []
    for i, (_, name) in enumerate(BANDS):
        mine = [r for r in rows if r["band"] == i]
        if mine:
            out.append(f"## {name} ({len(mine)})" if markdown else f"{name} ({len(mine)})")
            for r in mine:
                age = "ohne Datum" if r["age_days"] is None else "1 Tag" if r["age_days"] == 1 else f"{r['age_days']} Tage"
                out.append(f"- {r['title']} ({r['note']}, {age})")
            out.append("")
    return "\n".join(out)
