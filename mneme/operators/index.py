"""The index of points: building, idempotent replacement, deletion, and what is known per note.

Functions take DataFrames and return DataFrames; nothing is changed in place. Snapshots on storage
are versions of a :class:`mneme.operators.changefeed.ManifestTable` keyed by point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mneme.functions import text as tx

#: Fixed value: rows of a multi-vector that the store takes.
MOST_ROWS = 1000


def build_points(embedded: DataFrame, path: Column, domain: Column, run_id: Column, hash_: Column) -> DataFrame:
    """Points from embedded chunks; fails on a chunk without vectors or with more rows than the store takes."""
    rows = F.size("colbert")
    checked = F.when(F.col("dense").isNull(), F.raise_error(F.concat(F.lit("chunk without vectors: "), F.col("source")))).when(
        rows > MOST_ROWS, F.raise_error(F.concat(F.lit("chunk too large: "), F.col("source"), F.lit(f" has more than {MOST_ROWS} rows")))
    ).otherwise(F.col("dense"))
    return embedded.select(
        tx.point_id(path, F.col("chunk_id")).alias("point_id"), "text", path.alias("source"), path.alias("source_path"), "chunk_id",
        F.col("chunk_id").alias("chunk_offset"), "header", domain.alias("domain"), run_id.alias("run_id"), hash_.alias("content_hash"),
        *[c for c in ("updated", "geprueft", "quelle", "links") if c in embedded.columns], checked.alias("dense"), "sparse", "colbert",
    )


def latest_points(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per point: the one ingested last."""
    return chunks.groupBy("point_id").agg(F.max_by(F.struct(*columns), "ingested_at").alias("p")).select("point_id", "p.*")


def upsert(existing: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """``new`` replaces rows of the same key; columns are matched by name."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_stale(points: DataFrame, current: DataFrame) -> DataFrame:
    """Without the rows of a note in ``current`` (source_path, run_id) whose run is another or unknown."""
    keep = current.select("source_path", F.col("run_id").alias("__run"))
    return points.join(keep, "source_path", "left").where(F.col("__run").isNull() | F.col("run_id").eqNullSafe(F.col("__run"))).drop("__run")


def delete_sources(points: DataFrame, sources: DataFrame) -> DataFrame:
    return points.join(sources.select("source_path").distinct(), "source_path", "left_anti")


def changed_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose hash (case ignored) is not the indexed one; those without a hash always count as changed."""
    known = indexed.where("content_hash is not null").select("source_path", F.lower("content_hash").alias("__h")).distinct()
    return files.withColumn("__h", F.lower("content_hash")).join(known, ["source_path", "__h"], "left_anti").drop("__h")


def note_aggregates(points: DataFrame) -> DataFrame:
    """One row per note: point count, and the properties of its first point (smallest id); blank paths are left out."""
    first = lambda c: F.min_by(c, "point_id").alias(c)
    kept = [c for c in ("domain", "content_hash", "updated", "geprueft", "quelle", "links") if c in points.columns]
    return points.where("source_path <> ''").groupBy("source_path").agg(F.count_distinct("point_id").alias("chunk_count"), *[first(c) for c in kept])


def domain_counts(points: DataFrame) -> DataFrame:
    """Points per domain; no domain is no row."""
    return points.where("domain is not null").groupBy("domain").agg(F.count_distinct("point_id").alias("n"))


def domain_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a re-ingestion moves between domains: ``domain, delta``, without zeros."""
    plus = domain_counts(after).select("domain", F.col("n").alias("delta"))
    minus = domain_counts(before).select("domain", (-F.col("n")).alias("delta"))
    return plus.unionByName(minus).groupBy("domain").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def request_status(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """``paths`` with the status of an ingestion request: outside of the vault, unsupported, or ok."""
    p = F.col(path)
    lexical = p.startswith(root.rstrip("/") + "/") & ~p.rlike(r"(^|/)\.\.(/|$)")
    status = F.when(~lexical, "outside").when(F.lower(p).endswith(".pdf"), "pdf").when(~p.endswith(".md"), "unsupported").otherwise("ok")
    return paths.withColumn("status", status)


def neighbours_by_link(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """Notes joined to the asked ones by links, by file stem: ``source_path, neighbour, domain, direction``."""
    stems = notes.select(F.col("source_path").alias("p"), "domain", tx.file_stem(F.col("source_path")).alias("stem"))
    edges = notes.select(F.col("source_path").alias("p"), F.explode(F.array_distinct("links")).alias("link"))
    mine = asked.select("source_path").distinct().withColumn("own", tx.file_stem(F.col("source_path")))
    out = edges.join(mine, edges.p == mine.source_path).join(stems.drop("domain").withColumnRenamed("p", "n"), F.col("link") == F.col("stem")).select("source_path", "n", F.lit(True).alias("o"), F.lit(False).alias("i"))
    into = edges.withColumnRenamed("p", "n").join(mine, F.col("link") == F.col("own")).select("source_path", "n", F.lit(False).alias("o"), F.lit(True).alias("i"))
    both = out.unionByName(into).where("source_path <> n").groupBy("source_path", "n").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    direction = F.when(F.col("o") & F.col("i"), "both").when(F.col("o"), "outgoing").otherwise("incoming")
    return both.join(stems.select(F.col("p").alias("n"), "domain"), "n").select("source_path", F.col("n").alias("neighbour"), "domain", direction.alias("direction"))


def first_points(points: DataFrame, *columns: str) -> DataFrame:
    """Properties of each note's first point, the one with the smallest id."""
    return points.groupBy("source_path").agg(*[F.min_by(c, "point_id").alias(c) for c in columns])


def delete_legacy(points: DataFrame, current: DataFrame) -> DataFrame:
    """Without rows of older ingestions whose ``source`` is only the file's name, for the notes in ``current`` (source_path, run_id)."""
    names = current.select(tx.file_name(F.col("source_path")).alias("source"), F.col("run_id").alias("__run"))
    return points.join(names, "source", "left").where(F.col("__run").isNull() | F.col("run_id").eqNullSafe(F.col("__run"))).drop("__run")


def token_overlap(offsets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tokens of each chunk: those whose character range overlaps the chunk's, within their window.

    ``offsets`` has window, token, off_start, off_end; ``chunks`` has window, chunk_id, char_start,
    char_end. Special tokens end at 0 and belong nowhere. A chunk without any token gets all content
    tokens of its window.
    """
    content = offsets.where("off_end > 0")
    hit = chunks.join(content, "window").where("off_start < char_end and off_end > char_start").select("window", "chunk_id", "token")
    bare = chunks.join(hit.select("window", "chunk_id").distinct(), ["window", "chunk_id"], "left_anti")
    return hit.unionByName(bare.join(content, "window").select("window", "chunk_id", "token"))


def pool_sparse(token_weights: DataFrame) -> DataFrame:
    """Per chunk and vocabulary id the greatest non-negative weight: ``chunk_id, token_id, weight``."""
    weight = F.max(F.greatest("weight", F.lit(0.0)))
    return token_weights.groupBy("chunk_id", "token_id").agg(weight.alias("weight")).where("weight > 0")
