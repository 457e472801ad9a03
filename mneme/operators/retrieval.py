"""Hybrid retrieval for a batch of queries in one plan.

Queries are rows ``query_id, sub_idx, domain, dense, sparse, colbert``; a null domain searches all.
Dense candidates come from matrix products of query blocks with Arrow batches of points, each task
keeping its best per query; sparse ones from an equi-join of postings; their union is rescored by
late interaction; sub-queries are fused by reciprocal ranks. Ties always go to the smaller point id.
Null, empty and zero vectors are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mneme.functions import vector as vx
from mneme.storage import broadcast_if_small, materialize

#: Candidates per branch, reciprocal-rank constant, least depth factor, cross-encoder pool.
PREFETCH, RRF_K, LEAST_DEPTH, POOL = 100, 60, 3, 10
#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 20_000
#: Codes of a query that searches all domains (excludes nothing), and of a point without a domain (an owner).
ANY, NO_DOMAIN = -1, -2
KEYS = ["query_id", "sub_idx"]


def top(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their ``rank``; limited per task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def dense_topn(queries: DataFrame, points: DataFrame, n: int = PREFETCH, exclude: str | None = None) -> DataFrame:
    """``query_id, sub_idx, point_id, score, rank`` by exact cosine within the query's domain.

    With ``exclude``, a column of both sides, points that share its value with the query don't count.
    Domains and excluded values are compared by 64-bit codes. Up to ``QUERY_BLOCK`` queries need one scan
    of the points, which then do not move: each task keeps its best ``n`` per query.
    """
    spark, schema = points.sparkSession, "query_id long, sub_idx int, point_id string, score double"
    code = lambda c: F.when(c.isNotNull(), F.xxhash64(c.cast("string")))
    owner = F.col(exclude) if exclude else F.lit(None).cast("string")
    usable = points.where(vx.norm(F.col("dense")) > 0).select("point_id", F.coalesce(code(F.col("domain")), F.lit(NO_DOMAIN)).alias("domain"), F.coalesce(code(owner), F.lit(NO_DOMAIN)).alias("owner"), "dense")
    asked = queries.where(vx.norm(F.col("dense")) > 0).select(*KEYS, F.coalesce(code(F.col("domain")), F.lit(ANY)).alias("domain"), F.coalesce(code(owner), F.lit(ANY)).alias("owner"), "dense")
    found = spark.createDataFrame([], schema)
    for rows in _blocks(asked):
        found = found.unionByName(usable.mapInPandas(_dense_scan(spark, rows.to_pandas(), n), schema))
    return top(found, KEYS, n, F.round("score", 9).desc(), F.col("point_id"))


def _blocks(asked: DataFrame) -> Iterator:
    """The rows of ``asked`` as Arrow tables of at most about ``QUERY_BLOCK`` rows; few enough come in one job."""
    rows = asked.limit(QUERY_BLOCK + 1).toArrow()
    if len(rows) <= QUERY_BLOCK:
        if len(rows):
            yield rows
        return
    asked = materialize(asked, "asked")
    blocks = -(-asked.count() // QUERY_BLOCK)
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(*KEYS), F.lit(blocks)) == block).toArrow()
        if len(rows):
            yield rows


def _dense_scan(spark, rows: pd.DataFrame, n: int):
    matrix = np.stack(rows["dense"].to_numpy()).astype(np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast((matrix, *[rows[c].to_numpy() for c in ("domain", "owner", *KEYS)]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, domains, owners, ids, subs = shared.value
        bound, excluding = domains != ANY, bool((owners != ANY).any())
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["dense"].to_numpy()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own, names, theirs = batch["domain"].to_numpy(), batch["point_id"].to_numpy(), batch["owner"].to_numpy()
            # queries whose domain no row of the batch has need no product
            alive = np.flatnonzero(~bound | np.isin(domains, np.unique(own)))
            for at in range(0, len(alive), 256):
                part = alive[at : at + 256]
                s = matrix[part] @ x.T
                if bound[part].any():
                    s[bound[part, None] & (domains[part, None] != own[None, :])] = -np.inf
                if excluding:
                    s[owners[part, None] == theirs[None, :]] = -np.inf
                k = min(n, s.shape[1])
                edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                i, j = np.nonzero((s >= edge[:, None]) & np.isfinite(s))  # all that tie with the last one, so ties stay exact
                yield pd.DataFrame({"query_id": ids[part[i]], "sub_idx": subs[part[i]], "point_id": names[j], "score": s[i, j]})

    return scan


def sparse_topn(queries: DataFrame, points: DataFrame, n: int = PREFETCH) -> DataFrame:
    """``query_id, sub_idx, point_id, score, rank`` by the dot product over shared tokens; no shared token, no row."""
    asked = queries.select(*KEYS, F.col("domain").alias("wanted"), F.explode("sparse").alias("token", "qw"))
    postings = points.select("point_id", "domain", F.explode("sparse").alias("token", "w"))
    joined = postings.join(broadcast_if_small(asked), "token").where("wanted is null or wanted = domain")
    scores = joined.groupBy(*KEYS, "point_id").agg(F.sum(F.col("qw").cast("double") * F.col("w").cast("double")).alias("score"))
    return top(scores, KEYS, n, F.round("score", 9).desc(), F.col("point_id"))


def max_sim_rerank(queries: DataFrame, points: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Candidates rescored by late interaction and cut to ``k``."""
    q = queries.where(F.size("colbert") > 0).select(*KEYS, F.transform("colbert", vx.unit).alias("q"))
    d = points.where(F.size("colbert") > 0).select("point_id", "colbert")
    pairs = candidates.select(*KEYS, "point_id").distinct().join(d, "point_id")
    scored = pairs.withColumn("d", F.transform("colbert", vx.unit)).drop("colbert").join(broadcast_if_small(q), KEYS)
    scored = scored.select(*KEYS, "point_id", vx.max_sim(F.col("q"), F.col("d")).alias("score"))
    return top(scored, KEYS, k, F.round("score", 9).desc(), F.col("point_id"))


def hybrid(queries: DataFrame, points: DataFrame, k: int, prefetch: int = PREFETCH) -> DataFrame:
    """Late-interaction top ``k`` of the union of dense and sparse candidates, per sub-query."""
    candidates = dense_topn(queries, points, prefetch).select(*KEYS, "point_id").unionByName(sparse_topn(queries, points, prefetch).select(*KEYS, "point_id"))
    return max_sim_rerank(queries, points, candidates, k)


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """``query_id, point_id, score, rank``: reciprocal ranks summed over a query's lists, always in list order."""
    lists = F.array_sort(F.collect_list(F.struct("sub_idx", "rank")))
    total = F.aggregate(lists, F.lit(0.0), lambda s, r: s + F.lit(1.0) / (F.lit(float(k)) + r["rank"]))
    fused = ranked.groupBy("query_id", "point_id").agg(total.alias("sum"))
    ordered = Window.partitionBy("query_id").orderBy(F.desc("sum"), "point_id")
    return fused.select("query_id", "point_id", F.round("sum", 6).alias("score"), F.row_number().over(ordered).alias("rank"))


def rerank_pool(hits: DataFrame, pool: int = POOL, relevance: str = "relevance", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first ``pool`` hits of each list ``by`` in order of ``relevance`` (ties keep their order), the tail behind them unscored; ranks anew."""
    tail = F.col("rank") > pool
    value = F.when(~tail, F.col(relevance))
    order = Window.partitionBy(*by).orderBy(tail, F.desc(F.coalesce(value, F.lit(0.0))), "rank")
    return hits.withColumn("rerank_score", F.round(value, 6)).withColumn("new_rank", F.row_number().over(order)).drop("rank", relevance).withColumnRenamed("new_rank", "rank")


def depth(top_k: int, n_sub: Column) -> Column:
    """Hits per sub-query before fusion."""
    return F.lit(top_k) * F.greatest(n_sub, F.lit(LEAST_DEPTH))


def search(queries: DataFrame, points: DataFrame, top_k: int = 10, most_subs: int = 4, prefetch: int = PREFETCH) -> DataFrame:
    """``query_id, point_id, score, rank``: raw late-interaction scores for single sub-queries, fused ones otherwise."""
    subs = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sub"))
    lists = hybrid(queries, points, top_k * max(most_subs, LEAST_DEPTH), prefetch).join(subs, "query_id").where(F.col("rank") <= depth(top_k, F.col("n_sub")))
    fused = rrf(lists.where("n_sub > 1"))
    single = lists.where("n_sub = 1").select("query_id", "point_id", F.round("score", 6).alias("score"), "rank")
    return single.unionByName(fused).where(F.col("rank") <= top_k)


def decompose(questions: DataFrame, sub_queries: Column, question: str = "question") -> DataFrame:
    """One row per sub-query (``sub_idx, sub_query``); the question itself comes last unless it is among them."""
    q = F.col(question)
    subs = F.coalesce(sub_queries, F.array().cast("array<string>"))
    with_own = F.when(F.array_contains(subs, q), subs).otherwise(F.concat(subs, F.array(q)))
    return questions.select("*", F.posexplode(with_own).alias("sub_idx", "sub_query"))


def salvage_list(answer: Column) -> Column:
    """Sub-queries in a model's answer: a JSON list, or a JSON object's list or values; null where neither parses."""
    listed = F.from_json(F.regexp_extract(answer, r"(?s)\[.*\]", 0), "array<string>")
    inner = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    keyed = F.from_json(inner, "struct<queries:array<string>,sub_queries:array<string>,results:array<string>>")
    values = F.map_values(F.from_json(inner, "map<string,string>"))
    found = F.coalesce(listed, keyed["queries"], keyed["sub_queries"], keyed["results"], values)
    clean = F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(clean) > 0, clean)


def related(anchors: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Nearest points of other notes for each anchor (query_id, source_path, dense): ``query_id, point_id, score, rank``."""
    asked = anchors.select("query_id", F.lit(0).alias("sub_idx"), F.lit(None).cast("string").alias("domain"), "dense", "source_path")
    return dense_topn(asked, points, k, exclude="source_path").drop("sub_idx")


def anchor_vectors(points: DataFrame) -> DataFrame:
    """A note's anchor is the dense vector of its smallest point id."""
    return points.where(vx.norm(F.col("dense")) > 0).groupBy("source_path").agg(F.min_by("dense", "point_id").alias("dense"))
