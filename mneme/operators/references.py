"""References to records that do not exist.

References and parent keys are brought together by a sort-merge join: both sides are hashed to the
same partitions, sorted by key and read once in step. Parents carry validity intervals, so that a
reference without a present parent is told apart:

* ``missing``: no parent with this key was ever seen,
* ``deleted``: a parent was there and is gone,
* ``late``: the parent is there, but became valid after the reference was made,
* ``ok``: the parent is there and was there in time.

:func:`classify_intervals` looks closer: a key may have several intervals, and a reference was made
inside one of them (``valid_from <= at < valid_to``) or not. Starts, ends and references of a key are
one stream in the order of time, in which the number of open intervals is a running sum.

* ``missing``: no interval of this key is known,
* ``ok`` and ``deleted``: made inside of an interval, or before the first one ended; the parent is there now, or is not,
* ``late``: the parent is there now, but its first interval began after the reference was made,
* ``away`` and ``after``: made outside of all intervals once the first had begun; the parent has returned, or is gone for good.

Nulls and blanks among the references carry no key and are no references; a reference without a
time counts as made at the end of time, so it is never late. Repeated rows count once. Empty tables
give empty results; further columns of the inputs are ignored. A key that holds a third of all rows
is split by the adaptive skew join (parents have one row per key), and counts are combined before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mneme.functions.text import file_stem
from mneme.operators.ranking import running_sum

#: White space of any script at either end.
_EDGES = r"(?U)^\s+|\s+$"


def link_target(link: Column) -> Column:
    """The part of a link before the first ``#`` or ``|``, trimmed; null if nothing is left."""
    part = F.regexp_replace(F.regexp_extract(link, r"^([^#|]*)", 1), _EDGES, "")
    return F.when(part != "", part)


def parent_intervals(notes: DataFrame, feed: DataFrame | None = None) -> DataFrame:
    """One row per note path: ``path, valid_from, valid_to``; ``valid_to`` is null for present notes.

    Present notes come from ``notes`` (valid from the first ``indexed_at``). Paths that only the
    watcher's feed knows were there from their first upsert to their last deletion.
    """
    present = notes.where(F.col("source_path").isNotNull()).groupBy(F.col("source_path").alias("path")).agg(
        F.min("indexed_at").alias("valid_from")
    ).withColumn("valid_to", F.lit(None).cast("timestamp"))
    if feed is None:
        return present
    gone = (
        feed.where(F.col("source_path").isNotNull())
        .groupBy(F.col("source_path").alias("path"))
        .agg(
            F.min(F.when(F.col("op") == "upsert", F.col("seen_at"))).alias("valid_from"),
            F.max("seen_at").alias("valid_to"),
        )
        .where(F.col("valid_from").isNotNull())
        .join(present.select("path"), "path", "left_anti")
    )
    return present.unionByName(gone.select("path", "valid_from", "valid_to"))


def presence_intervals(notes: DataFrame, feed: DataFrame) -> DataFrame:
    """All stretches in which a note path was there: ``path, valid_from, valid_to``, several per path.

    In the feed a path comes with an upsert and goes with the next deletion, in the order of
    ``seen_at`` (an upsert before a deletion at the same time). A path without an end that ``notes`` does not hold was last there when it was last
    seen; one that ``notes`` holds is there from its first ``indexed_at`` on.
    """
    seen = feed.where(F.col("source_path").isNotNull() & F.col("seen_at").isNotNull()).groupBy(F.col("source_path").alias("path"), "seen_at").agg(
        F.max(F.col("op") == "delete").alias("gone"), F.max(F.col("op") == "upsert").alias("there")
    )
    by_time = Window.partitionBy("path").orderBy("seen_at")
    # a time with both begins (unless the path was there) and ends an interval at once: the end counts
    turns = seen.where("gone or there").withColumn("before", F.lag("gone").over(by_time)).where(F.col("before").isNull() | (F.col("before") != F.col("gone")))
    ended = turns.withColumn("valid_to", F.lead("seen_at").over(by_time)).where("not gone").select("path", F.col("seen_at").alias("valid_from"), "valid_to")
    present = notes.where(F.col("source_path").isNotNull()).groupBy(F.col("source_path").alias("path")).agg(F.min("indexed_at").alias("valid_from"))
    last = seen.groupBy("path").agg(F.max("seen_at").alias("last"))
    unended = ended.where("valid_to is null").join(present.select("path"), "path", "left_anti").join(last, "path").select("path", "valid_from", F.col("last").alias("valid_to"))
    return ended.where("valid_to is not null").unionByName(unended).unionByName(present.withColumn("valid_to", F.lit(None).cast("timestamp")))


def classify_intervals(references: DataFrame, intervals: DataFrame) -> DataFrame:
    """``references`` (key, at, ...) with a column ``status``; ``intervals`` has key, valid_from, valid_to, any number per key."""
    end = F.lit("9999-01-01").cast("timestamp")
    placed = intervals.where("key is not null").select("key", F.coalesce("valid_from", F.lit("0001-01-01").cast("timestamp")).alias("valid_from"), "valid_to")
    known = placed.groupBy("key").agg(F.max(F.col("valid_to").isNull()).alias("present"), F.min("valid_from").alias("first"))
    begun = placed.select("key", F.col("valid_from").alias("at"), F.lit(1).alias("delta"))
    closed = placed.where("valid_to is not null").select("key", F.col("valid_to").alias("at"), F.lit(-1).alias("delta"))
    turns = begun.unionByName(closed).groupBy("key", "at").agg(F.sum("delta").alias("delta"))
    times = references.select("key", F.coalesce("at", end).alias("at")).distinct()
    merged = turns.withColumn("asked", F.lit(False)).unionByName(times.withColumn("delta", F.lit(0).cast("long")).withColumn("asked", F.lit(True)))
    opened = running_sum(merged, "key", ["at", "asked"], "delta", "n").where("asked").select("key", F.col("at").alias("__at"), (F.col("n") > 0).alias("inside"))
    joined = references.withColumn("__at", F.coalesce("at", end)).join(opened, ["key", "__at"], "left").join(known.hint("merge"), "key", "left")
    early = F.col("__at") < F.col("first")
    status = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("present"), F.when(F.col("inside"), "ok").when(early, "late").otherwise("away"))
        .otherwise(F.when(F.col("inside") | early, "deleted").otherwise("after"))
    )
    return joined.withColumn("status", status).drop("__at", "inside", "present", "first")


def vault_history(notes: DataFrame, chunks: DataFrame, feed: DataFrame) -> DataFrame:
    """All references of the vault by the intervals of their parents: ``tab, source_path, target, at, status``."""
    intervals = presence_intervals(notes, feed)
    of_notes = classify_intervals(note_references(notes), intervals.withColumn("key", file_stem(F.col("path"))))
    of_chunks = classify_intervals(chunk_references(chunks), intervals.withColumn("key", F.col("path")))
    return of_notes.unionByName(of_chunks).drop("key")


def _parents(intervals: DataFrame, key: Column) -> DataFrame:
    return intervals.groupBy(key.alias("key")).agg(
        F.max(F.col("valid_to").isNull()).alias("present"),
        F.min(F.when(F.col("valid_to").isNull(), F.col("valid_from"))).alias("present_from"),
    )


def classify(references: DataFrame, parents: DataFrame) -> DataFrame:
    """``references`` (key, at, ...) with a column ``status``; ``parents`` has key, present, present_from."""
    joined = references.join(parents.hint("merge"), "key", "left")
    status = (
        F.when(F.col("present").isNull(), "missing")
        .when(~F.col("present"), "deleted")
        .when(F.col("present_from") > F.col("at"), "late")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("present", "present_from")


def note_references(notes: DataFrame) -> DataFrame:
    """The links of ``notes``: ``tab, source_path, target, key, at``, once each, at their first time."""
    links = notes.select(
        "source_path", F.col("indexed_at").alias("at"), F.explode("links").alias("link")
    ).select("source_path", "at", link_target(F.col("link")).alias("target"))
    return (
        links.where("target is not null")
        .groupBy("source_path", "target")
        .agg(F.min("at").alias("at"))
        .select(F.lit("notes").alias("tab"), "source_path", "target", F.col("target").alias("key"), "at")
    )


def chunk_references(chunks: DataFrame) -> DataFrame:
    """The note paths of ``chunks``: ``tab, source_path, target, key, at``, one row per point."""
    return (
        chunks.where(F.col("source_path").isNotNull())
        .groupBy("point_id", "source_path")
        .agg(F.min("ingested_at").alias("at"))
        .select(
            F.lit("chunks").alias("tab"), "source_path", F.col("source_path").alias("target"),
            F.col("source_path").alias("key"), "at",
        )
    )


def vault_references(notes: DataFrame, chunks: DataFrame, feed: DataFrame | None = None) -> DataFrame:
    """All references of the vault with ``status``: ``tab, source_path, target, at, status``."""
    intervals = parent_intervals(notes, feed)
    of_notes = classify(note_references(notes), _parents(intervals, file_stem(F.col("path"))))
    of_chunks = classify(chunk_references(chunks), _parents(intervals, F.col("path")))
    return of_notes.unionByName(of_chunks).drop("key")


def dangling(references: DataFrame) -> DataFrame:
    """References without a present parent, once each: ``tab, source_path, target``."""
    return references.where(F.col("status").isin("missing", "deleted")).select("tab", "source_path", "target").distinct()


def report(references: DataFrame) -> DataFrame:
    """Counts per table, month and status: ``tab, month, status, n_references, n_targets``."""
    return references.groupBy(
        "tab", F.date_format(F.col("at"), "yyyy-MM").alias("month"), "status"
    ).agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("target").alias("n_targets"))
