"""From hits to a prompt and an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.models import Generator, generate

#: The answer where nothing was found; no model is asked then.
NOTHING = "Keine passenden Notizen gefunden."
INSTRUCTION = "Beantworte die Frage allein aus den Abschnitten und nenne sie."


def long_context_position(rank: Column, n: Column) -> Column:
    """New place of a hit: the best first, the second best last, the others between in order; up to two stay."""
    return F.when((n <= 2) | (rank == 1), rank).when(rank == 2, n).otherwise(rank - 1)


def reorder(hits: DataFrame, group: str = "query_id") -> DataFrame:
    n = hits.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return hits.join(n, group).withColumn("position", long_context_position(F.col("rank"), F.col("__n"))).drop("__n")


def prompts(hits: DataFrame, questions: DataFrame, group: str = "query_id") -> DataFrame:
    """``query_id, prompt`` from placed hits (position, header, source, text); every field is made harmless."""
    header, source = tx.sanitize(F.coalesce("header", F.lit("")), 200), tx.sanitize(F.coalesce("source", F.lit("")), 200)
    label = F.concat(
        F.lit("[Abschnitt "), F.col("position").cast("string"), F.lit("]"), F.when(header != "", F.concat(F.lit(" "), header)).otherwise(""),
        F.when(source != "", F.concat(F.lit(" (Quelle: "), source, F.lit(")"))).otherwise(""),
    )
    parts = hits.withColumn("part", F.concat(label, F.lit("\n"), tx.sanitize(tx.strip(F.col("text")))))
    context = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", "part"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["part"]), "\n\n---\n\n")
    asked = questions.select(group, tx.sanitize(F.col("question"), 500).alias("q"))
    return context.join(asked, group).select(
        group, F.concat(F.lit(INSTRUCTION + "\n\n=== KONTEXT ===\n\n"), joined, F.lit("\n\n=== FRAGE ===\n\n"), F.col("q"), F.lit("\n\n=== ANTWORT ===")).alias("prompt")
    )


def ask(prompted: DataFrame, questions: DataFrame, generator: Generator, group: str = "query_id") -> DataFrame:
    """``query_id, answer`` for every question; those without hits get the fixed sentence."""
    answered = generate(prompted, F.col("prompt"), generator).select(group, "answer")
    return questions.select(group).join(answered, group, "left").withColumn("answer", F.coalesce("answer", F.lit(NOTHING)))
