"""An inverted index over dense vectors, for search that need not look at every point.

Points lie in the list of their nearest centroid; a query looks into the lists of its nearest
centroids only, and what it finds there is scored exactly. The centroids come from spherical k-means
over a bounded sample (about ``SAMPLE`` points, drawn by hash); every point is in the index. With as
many probes as lists the result is that of :func:`mneme.operators.retrieval.dense_topn`.

Null, empty and zero vectors are in no list. An empty table has an index without lists, in which
nothing is found. A list that holds many points is searched in parts of about ``PART`` points, so a
third of all points in one list is no hot spot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mneme.functions import vector as vx
from mneme.operators.retrieval import ANY, KEYS, NO_DOMAIN, top
from mneme.storage import materialize

#: Points that the centroids are learned from, rounds of learning, lists at most, points that one task searches at once.
SAMPLE, ROUNDS, MOST_LISTS, PART = 65_536, 12, 4096, 50_000


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn_centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Spherical k-means of vectors of length one; a centroid that loses all its vectors starts anew at the vector worst served."""
    centroids = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        own, served = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[np.argsort(served)[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    return centroids


class VectorIndex:
    """Points (point_id, domain, dense) in lists; ``rows`` has them with their ``list``, written once."""

    def __init__(self, points: DataFrame, lists: int | None = None) -> None:
        domain = F.when(F.col("domain").isNull(), F.lit(NO_DOMAIN)).otherwise(F.xxhash64("domain"))
        usable = materialize(points.where(vx.norm(F.col("dense")) > 0).select("point_id", domain.alias("domain"), "dense"), "usable")
        size = usable.count()
        drawn = usable.where(F.pmod(F.xxhash64("point_id"), F.lit(max(1, size))) < SAMPLE).select("dense").toArrow()["dense"].to_pandas()
        lists = min(MOST_LISTS, len(drawn), lists or max(1, round(math.sqrt(size))))
        self.centroids = learn_centroids(_unit(drawn), lists) if lists else np.empty((0, 1))
        nearest = self._nearest(usable.sparkSession, 1)
        self.rows = materialize(usable.withColumn("list", nearest("dense")[0]), "lists")
        loads = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
        self.parts = materialize(loads, "parts")  # one row per list

    def _nearest(self, spark, probes: int):
        """A column function: the nearest lists of a vector, nearest first."""
        shared = spark.sparkContext.broadcast(self.centroids)

        @F.pandas_udf("array<int>")
        def run(vectors: pd.Series) -> pd.Series:
            near = _unit(vectors) @ shared.value.T
            return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return run

    def search(self, queries: DataFrame, n: int, probes: int) -> DataFrame:
        """``query_id, sub_idx, point_id, score, rank``: the best ``n`` of the lists that each query looks into."""
        spark, schema = queries.sparkSession, "query_id long, sub_idx int, point_id string, score double"
        asked = queries.where(vx.norm(F.col("dense")) > 0).select(*KEYS, F.when(F.col("domain").isNull(), F.lit(ANY)).otherwise(F.xxhash64("domain")).alias("domain"), "dense")
        if not len(self.centroids):
            return top(spark.createDataFrame([], schema), KEYS, n, F.col("score").desc(), F.col("point_id"))
        probed = asked.withColumn("list", F.explode(self._nearest(spark, probes)("dense"))).join(F.broadcast(self.parts), "list")
        probed = probed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = self.rows.join(F.broadcast(self.parts), "list").withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int"))

        def match(points: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(points) or not len(wanted):
                return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("query_id", "int64"), ("sub_idx", "int32"), ("point_id", object), ("score", float))})
            x, own, names, out = _unit(points["dense"]).T, points["domain"].to_numpy(), points["point_id"].to_numpy(object), []
            for at in range(0, len(wanted), 256):
                part = wanted.iloc[at : at + 256]
                s, domains = _unit(part["dense"]) @ x, part["domain"].to_numpy()
                s[(domains[:, None] != ANY) & (domains[:, None] != own[None, :])] = -np.inf
                k = min(n, s.shape[1])
                edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                i, j = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
                out.append((part["query_id"].to_numpy()[i], part["sub_idx"].to_numpy()[i], names[j], s[i, j]))
            made = {c: np.concatenate(values) for c, values in zip(("query_id", "sub_idx", "point_id", "score"), zip(*out))}
            return pd.DataFrame(made | {"point_id": pd.Series(made["point_id"], dtype=object)})

        by = ["list", "part"]
        found = held.groupBy(*by).cogroup(probed.select(*KEYS, "domain", "dense", *by).groupBy(*by)).applyInPandas(match, schema)
        return top(found, KEYS, n, F.round("score", 9).desc(), F.col("point_id"))
