"""Measuring retrieval and answers.

Hits are rows ``case_id, rank, note, text, score``; cases ``id, typ, frage, soll, darf_nicht`` with
evidence ``soll`` (notiz, beleg). Evidence is found where a hit of its note holds it word for word,
white space aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.functions.stats import floor_index
from mneme.models import COST_CHARS_PER_TOKEN, Judge, generate

#: Selections from the candidates: name, how many, how many per note at most.
VARIANTS = (("k10", 10, None), ("k5", 5, None), ("k3", 3, None), ("k5_max2", 5, 2), ("k5_max1", 5, 1))
#: Types that say nothing about quality, only about cost.
UNMEASURED = ("negativ", "geschuetzt")
#: Labels of the three judgements, the first of each being the one that passes.
LABELS = {
    "context_relevance": ("RELEVANT", "TEILWEISE_RELEVANT", "IRRELEVANT"),
    "groundedness": ("VOLLSTÄNDIG_BELEGT", "TEILWEISE_BELEGT", "NICHT_BELEGT", "WIDERSPRÜCHLICH"),
    "answer_relevance": ("BEANTWORTET", "TEILWEISE_BEANTWORTET", "NICHT_BEANTWORTET", "ABLENKUNG"),
}


def select_variants(hits: DataFrame) -> DataFrame:
    """Every hit once per variant that shows it, with its new ``rank`` there."""
    spark = hits.sparkSession
    variants = spark.createDataFrame(VARIANTS, "variant string, k int, per_note int")
    in_note = F.row_number().over(Window.partitionBy("case_id", "note").orderBy("rank"))
    each = hits.withColumn("__n", in_note).crossJoin(F.broadcast(variants)).where("per_note is null or __n <= per_note")  # five variants
    place = F.row_number().over(Window.partitionBy("variant", "case_id").orderBy("rank"))
    return each.withColumn("rank", place).where(F.col("rank") <= F.col("k")).drop("__n", "k", "per_note")


def evidence_hits(hits: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Hits that hold evidence of their case: ``keys, rank, evidence`` (its number)."""
    soll = cases.select(F.col("id").alias("case_id"), F.posexplode("soll").alias("evidence", "s")).select("case_id", "evidence", F.col("s.notiz").alias("note"), tx.collapse(F.col("s.beleg")).alias("passage"))
    return hits.join(soll, ["case_id", "note"]).where(F.contains(tx.collapse(F.col("text")), F.col("passage"))).select(*keys, "rank", "evidence")


#: Fixed value: the heading of a hit as it is shown; the note's place comes first where it is.
HEADING = "## Result %d (score: %.2f, source: %s%s.md)"
#: The folder that headings name before a note.
FOLDER = "/vault/notes/"


def formatted_length(rank: Column, score: Column, note: Column, text: Column, folder: str = FOLDER) -> Column:
    """Characters of one hit as it is shown: heading, text, blank line, each with its line break."""
    head = F.format_string(HEADING, rank, score, F.lit(folder), note)
    return F.length(head) + F.length(tx.strip(text)) + 3


#: Fixed value: length of the line below the hits.
FOOTER = len("*Cache hit: false, latency: 100ms*")


def score_cases(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Per variant and case: ranks of the first right note and passage, coverage, cost, useful share, repeats, leaks."""
    keys = ["variant", "case_id"]
    wanted = cases.select(F.col("id").alias("case_id"), "typ", F.size("soll").alias("n_soll"), F.transform("soll", lambda s: s["notiz"]).alias("notes"), "darf_nicht")
    found = evidence_hits(hits, cases, keys)
    passage = found.groupBy(*keys).agg(F.min("rank").alias("passage_rank"), F.count_distinct("evidence").alias("covered"))
    useful = found.select(*keys, "rank").distinct().withColumn("useful", F.lit(True))
    rows = hits.join(wanted.select("case_id", "notes", "darf_nicht"), "case_id").join(useful, [*keys, "rank"], "left")
    length = F.length("text")
    per_case = rows.groupBy(*keys).agg(
        F.min(F.when(F.array_contains("notes", F.col("note")), F.col("rank"))).alias("note_rank"),
        (F.sum(formatted_length(F.col("rank"), F.col("score"), F.col("note"), F.col("text"))) + FOOTER).alias("chars"),
        F.sum(F.when(F.col("useful"), length).otherwise(0)).alias("useful_chars"), F.sum(length).alias("text_chars"),
        (F.count(F.lit(1)) - F.count_distinct("note")).alias("repeats"),
        F.array_sort(F.collect_set(F.when(F.array_contains("darf_nicht", F.col("note")), F.col("note")))).alias("leaks"),
        F.min_by("score", "rank").alias("best_score"),
    )
    variants = hits.sparkSession.createDataFrame([(v[0],) for v in VARIANTS], "variant string")
    every = wanted.crossJoin(F.broadcast(variants))  # five variants per case
    joined = every.join(per_case, keys, "left").join(passage, keys, "left")
    return joined.select(
        *keys, "typ", "note_rank", "passage_rank",
        F.when(F.col("n_soll") > 0, F.coalesce("covered", F.lit(0)) / F.col("n_soll")).alias("coverage"),
        F.coalesce("chars", F.lit(FOOTER)).alias("chars"),
        F.when(F.col("text_chars") > 0, F.col("useful_chars") / F.col("text_chars")).otherwise(0.0).alias("useful_share"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("leaks", F.array().cast("array<string>")).alias("leaks"), "best_score",
    )


def summarize(scored: DataFrame) -> DataFrame:
    """Figures per variant, and per variant and type (grouping sets; ``typ`` is null for the whole)."""
    measured = ~F.col("typ").isin(*UNMEASURED)
    n = F.greatest(F.count_if(F.col("__m")), F.lit(1))
    up_to = lambda c, k: F.count_if(F.col("__m") & (F.col(c) <= k)) / n
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("__m"), F.col(c))), F.lit(0.0))
    rows = scored.withColumn("__m", measured)
    return rows.groupingSets([["variant"], ["variant", "typ"]], "variant", "typ").agg(
        F.count(F.lit(1)).alias("cases"), up_to("note_rank", 1).alias("note_recall_1"), up_to("note_rank", 99).alias("note_recall_k"),
        up_to("passage_rank", 1).alias("passage_recall_1"), up_to("passage_rank", 3).alias("passage_recall_3"), up_to("passage_rank", 99).alias("passage_recall_k"),
        mean("coverage").alias("coverage"), (F.coalesce(F.sum(F.when(F.col("__m"), 1.0 / F.col("passage_rank"))), F.lit(0.0)) / n).alias("mrr"),
        F.median("chars").alias("chars_median"), floor_index(F.collect_list("chars"), 0.9).alias("chars_p90"),
        F.round(F.median("chars") / COST_CHARS_PER_TOKEN).cast("long").alias("tokens_median"), mean("useful_share").alias("useful_share"),
        F.avg("repeats").alias("repeats_mean"), F.count_if(F.size("leaks") > 0).alias("leaks"),
    )


def orphaned_cases(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Ids of cases with evidence that its note no longer holds; ``notes`` has note, text."""
    soll = cases.select("id", F.explode("soll").alias("s")).select("id", F.col("s.notiz").alias("note"), tx.collapse(F.col("s.beleg")).alias("passage"))
    holds = soll.join(notes, "note", "left").withColumn("ok", F.coalesce(F.contains(tx.collapse(F.col("text")), F.col("passage")), F.lit(False)))
    return holds.groupBy("id", "note", "passage").agg(F.max("ok").alias("ok")).where("not ok").select("id").distinct()


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per case: whether its passage was found by both, newly, lost, or by neither."""
    joined = a.select("case_id", F.col("passage_rank").alias("ra")).join(b.select("case_id", F.col("passage_rank").alias("rb")), "case_id")
    outcome = F.when(F.col("ra").isNull() & F.col("rb").isNotNull(), "found").when(F.col("ra").isNotNull() & F.col("rb").isNull(), "lost").when(F.col("ra").isNull(), "neither").otherwise("both")
    return joined.withColumn("outcome", outcome)


def judge_label(raw: Column, labels: tuple[str, ...]) -> Column:
    """The label in a judge's answer: of its JSON, else the first ``[LABEL]``, else PARSING_FAILED."""
    parsed = F.upper(F.trim(F.try_variant_get(F.try_parse_json(F.trim(raw)), "$.label", "string")))
    bracket = F.regexp_extract(raw, r"\[([A-ZÄÖÜ_]+)\]", 1)
    return F.when(parsed.isin(*labels), parsed).when(bracket.isin(*labels), bracket).otherwise("PARSING_FAILED")


def triad_passes(context: Column, ground: Column, answer: Column) -> Column:
    first = [v[0] for v in LABELS.values()]
    return F.coalesce((context == first[0]) & (ground == first[1]) & (answer == first[2]), F.lit(False))


def judge_summary(results: DataFrame) -> DataFrame:
    """Label counts in long form: ``metric, label, n``; results have one column per judgement."""
    long = results.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(m, F.lit("UNKNOWN")).alias("label")) for m in LABELS])).alias("x"))
    return long.groupBy("x.metric", "x.label").agg(F.count(F.lit(1)).alias("n"))


def judge_totals(results: DataFrame) -> DataFrame:
    """Pass rate, failures and mean latency of all judged cases."""
    def having(*wanted: str) -> Column:
        counts = [F.when(F.col(m).isin(*wanted), 1).otherwise(0) for m in LABELS]
        return F.coalesce(F.sum(counts[0] + counts[1] + counts[2]), F.lit(0))

    n = F.count(F.lit(1))
    return results.withColumn("__p", triad_passes(*[F.col(m) for m in LABELS])).agg(
        n.alias("total_cases"), F.when(n > 0, F.count_if(F.col("__p")) / n).otherwise(0.0).alias("pass_rate"),
        having("PARSING_FAILED").alias("parsing_failed"), having("JUDGE_UNAVAILABLE", "JUDGE_TIMEOUT").alias("unavailable"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )


def stability(judged: DataFrame, case: str, label: str) -> DataFrame:
    """Per case the most frequent label over its runs (ties: the smallest) and its share."""
    counts = judged.groupBy(case, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(case).agg(F.max("n").alias("top"), F.sum("n").alias("runs")).join(counts, case).where("n = top").groupBy(case).agg(
        F.min(label).alias("label"), (F.first("top") / F.first("runs")).alias("stability")
    )


def keyword_ranks(hits: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rank of the first hit with each case's keyword, case ignored: ``case_id, keyword_rank``; null for none."""
    joined = keywords.join(hits.select("case_id", "rank", "text"), "case_id", "left")
    return joined.groupBy("case_id").agg(F.min(F.when(F.contains(F.lower("text"), F.lower("keyword")), F.col("rank"))).alias("keyword_rank"))


def rank_only(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Rank of the expected and of the secondary keyword, and whether the expected source is among the first three."""
    first = keyword_ranks(hits, cases.select("case_id", F.col("expected_keyword").alias("keyword")))
    second = keyword_ranks(hits, cases.select("case_id", F.col("expected_secondary_keyword").alias("keyword"))).withColumnRenamed("keyword_rank", "secondary_rank")
    near = cases.select("case_id", "expected_source").join(hits.select("case_id", "rank", "note"), "case_id", "left")
    top3 = near.groupBy("case_id").agg(F.coalesce(F.max((F.col("rank") <= 3) & F.contains("note", "expected_source")), F.lit(False)).alias("source_in_top3"))
    return first.join(second, "case_id").join(top3, "case_id")


def category_stats(results: DataFrame) -> DataFrame:
    """Passed cases per category: results have category, passed."""
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"))


def negative_scores(scored: DataFrame, variant: str = "k10") -> DataFrame:
    """How high the best hits of cases without an answer score."""
    rows = scored.where((F.col("variant") == variant) & (F.col("typ") == "negativ") & F.col("best_score").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.median("best_score").alias("median"), F.min("best_score").alias("least"), F.max("best_score").alias("most"))


#: What each judgement is about, and what it is given.
TASKS = {
    "context_relevance": ("Beurteile, ob der Kontext hilft, die Frage zu beantworten.", ("question", "context")),
    "groundedness": ("Beurteile, ob jede Aussage der Antwort im Kontext steht.", ("context", "answer")),
    "answer_relevance": ("Beurteile, ob die Antwort auf die Frage eingeht.", ("question", "answer")),
}
_NAMES = {"question": "Frage", "context": "Kontext", "answer": "Antwort"}


def triad_prompts(question: Column, contexts: Column, answer: Column) -> dict[str, Column]:
    """One prompt per judgement: the task, its labels, and what is judged, every field made harmless."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("[Abschnitt "), (i + 1).cast("string"), F.lit("]\n"), tx.sanitize(c)))
    given = {"question": tx.sanitize(question), "context": F.array_join(numbered, "\n\n"), "answer": tx.sanitize(answer)}
    prompts = {}
    for metric, (task, fields) in TASKS.items():
        head = f'{task}\nErlaubt sind: {", ".join(LABELS[metric])}.\nAntworte als JSON mit "label" und "begruendung".\n\n=== EINGABE ==='
        prompts[metric] = F.concat(F.lit(head), *[x for f in fields for x in (F.lit(f"\n\n{_NAMES[f]}:\n"), given[f])], F.lit("\n\n=== BEWERTUNG ==="))
    return prompts


def judge_answers(rows: DataFrame, judge: Judge) -> DataFrame:
    """``rows`` (question, contexts, answer) judged; where any of the three is empty nothing is asked and the case fails."""
    whole = (F.coalesce(F.col("question"), F.lit("")) != "") & (F.size("contexts") > 0) & (F.coalesce(F.col("answer"), F.lit("")) != "")
    judged = judge_cases(rows.where(whole), triad_prompts(F.col("question"), F.col("contexts"), F.col("answer")), judge)
    return judged.unionByName(rows.where(~F.coalesce(whole, F.lit(False))).withColumn("overall_pass", F.lit(False)), allowMissingColumns=True)


def judge_cases(cases: DataFrame, prompts: dict[str, Column], judge: Judge) -> DataFrame:
    """Labels of all three judgements and whether the case passes; ``prompts`` has one prompt per judgement."""
    out = cases
    for metric, labels in LABELS.items():
        out = generate(out, prompts[metric], judge, f"__{metric}").withColumn(metric, judge_label(F.col(f"__{metric}"), labels)).drop(f"__{metric}")
    return out.withColumn("overall_pass", triad_passes(*[F.col(m) for m in LABELS]))


def report_text(summary: DataFrame) -> str:
    """The summary as Markdown: one table of the variants, one of passage recall by type."""
    rows = summary.orderBy("variant", F.asc_nulls_first("typ")).collect()
    out = ["| Variante | Stelle @1 | @3 | @k | Notiz @k | MRR | Tokens | Lecks |", "|---|---|---|---|---|---|---|---|"]
    out += [f"| {r['variant']} | {r['passage_recall_1']:.2f} | {r['passage_recall_3']:.2f} | {r['passage_recall_k']:.2f} | {r['note_recall_k']:.2f} | {r['mrr']:.2f} | {r['tokens_median']} | {r['leaks']} |" for r in rows if r["typ"] is None]
    out += ["", "| Variante | Typ | Fälle | Stelle @k |", "|---|---|---|---|"]
    return "\n".join(out + [f"| {r['variant']} | {r['typ']} | {r['cases']} | {r['passage_recall_k']:.2f} |" for r in rows if r["typ"] is not None])
