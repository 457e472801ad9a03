"""The semantic result cache: exact look-up first, then the nearest query above a threshold.

Entries are rows ``cache_id, sub_query, sub_query_normalized, domain, created_at, hit_count, dense,
chunks``. Look-ups carry ``lookup_id, sub_query, domain, dense``. No domain is ``_global``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.operators.retrieval import dense_topn

#: Least similarity of a semantic hit, seconds that an entry lives.
THRESHOLD, TTL = 0.95, 604_800


def _domain(df: DataFrame) -> Column:
    return F.coalesce(df["domain"], F.lit("_global"))


def make_entries(results: DataFrame, now: Column) -> DataFrame:
    """Entries for results (sub_query, domain, dense, chunks) that found something."""
    return results.where(F.size("chunks") > 0).select(
        tx.cache_id(F.col("domain"), F.col("sub_query")).alias("cache_id"), "sub_query", tx.normalize_query(F.col("sub_query")).alias("sub_query_normalized"),
        _domain(results).alias("domain"), now.alias("created_at"), F.lit(0).alias("hit_count"), "dense", "chunks",
    )


def live(entries: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    return entries.where(F.col("created_at") >= now - F.make_dt_interval(secs=F.lit(ttl)))


def lookup(lookups: DataFrame, entries: DataFrame, now: Column, threshold: float = THRESHOLD, ttl: int = TTL) -> DataFrame:
    """``lookup_id, cache_id, stage, similarity`` of the hits; an entry without chunks is no hit.

    The first stage joins on the normalised query and domain. Only its misses go to the second,
    which scans the entries of their domain for the most similar one (a blocked matrix product). Ties go to the smaller entry id.
    """
    usable = live(entries, now, ttl).where(F.size("chunks") > 0)
    asked = lookups.withColumn("domain", _domain(lookups)).withColumn("norm", tx.normalize_query(F.col("sub_query")))
    same = usable.select("domain", F.col("sub_query_normalized").alias("norm"), "cache_id")
    exact = asked.join(same, ["domain", "norm"]).groupBy("lookup_id").agg(F.min("cache_id").alias("cache_id"))
    exact = exact.select("lookup_id", "cache_id", F.lit("exact").alias("stage"), F.lit(1.0).alias("similarity"))
    missed = asked.join(exact.select("lookup_id"), "lookup_id", "left_anti")
    asking = missed.select(F.xxhash64("lookup_id").alias("query_id"), F.lit(0).alias("sub_idx"), "domain", "dense", "lookup_id")
    entry = usable.select(F.col("cache_id").alias("point_id"), "domain", "dense")
    nearest = dense_topn(asking, entry, 1).where(F.col("score") >= threshold)
    near = nearest.join(asking.select("query_id", "lookup_id"), "query_id")
    return exact.unionByName(near.select("lookup_id", F.col("point_id").alias("cache_id"), F.lit("semantic").alias("stage"), F.col("score").alias("similarity")))


def count_hits(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Entries with their hit counts raised by the log of look-ups."""
    n = hits.groupBy("cache_id").agg(F.count(F.lit(1)).alias("__n"))
    return entries.join(n, "cache_id", "left").withColumn("hit_count", (F.col("hit_count") + F.coalesce("__n", F.lit(0))).cast("int")).drop("__n")


def cleanup(entries: DataFrame, now: Column, ttl: int = TTL, domain: str | None = None) -> DataFrame:
    """Without expired entries, of one domain or of all."""
    old = F.col("created_at") < now - F.make_dt_interval(secs=F.lit(ttl))
    return entries.where(~(old & (F.col("domain") == domain) if domain else old))


def invalidate(entries: DataFrame, domain: str, with_global: bool = False) -> DataFrame:
    """Without a domain's entries; those of ``_global`` go only on demand."""
    return entries.where(~F.col("domain").isin(domain, "_global") if with_global else F.col("domain") != domain)


def totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))
