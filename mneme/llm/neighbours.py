"""Most similar vectors for every vector: multi-index hashing with a float rerank.

Codes: vectors of length one are rotated by learned rotations (each found by iterative quantisation
of a bounded sample, from a start of its own) and cut to their signs; a code has ``tables``
substrings of ``bits`` bits. Every substring is an index of its own. By the pigeonhole principle two
codes that differ in fewer bits than there are substrings agree in at least one substring, so
probing each index at distance zero retrieves *every* code within the Hamming radius
``tables - 1``; codes farther apart are retrieved with the probability that some substring agrees,
1 - (1 - (1 - a/pi)^bits)^tables for an angle a. Substrings have about log2(n) bits, so the buckets
stay small as the collection grows, and there are as many of them as keep that probability at
``RECALL`` for the least cosine asked for. Candidates that survive a signature check get their exact
cosine, in double precision.

Work is done on classes of equal vectors, so a vector that fills a third of the table is one entry
of the index; the members of a class come back through at most ``2 * k`` representatives, which is
all that a top-k with exclusion of the own group can use. A bucket with more
than about ``HOT`` different vectors (many merely similar ones) is not paired up: its members get
their neighbours by an exact scan in blocks, which keeps the best per query; nothing is capped.

Null, empty, zero and non-finite vectors have no neighbours, nor do vectors whose length is not the
collection's most frequent one. Repeated rows of a key count once. Rows without key are left out; a
null group is a group of its own. Ties in the cosine go to the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mneme.storage import materialize, partitions_for

#: Vectors from which the rotations are learned (about so many, drawn by hash; all others are indexed too).
SAMPLE = 8192
#: Different vectors in a bucket from which its members are scanned for instead of paired.
HOT = 4096
#: Queries that an exact scan sends to the tasks at once.
QUERY_BLOCK = 20_000
#: Substrings a code has at least, and signature bits that may differ.
TABLES, SIGNATURE_RADIUS = 64, 19
#: Probability with which a pair at the least cosine shares a substring.
RECALL = 0.99


def bits_for(size: int) -> int:
    """Bits of a substring for so many classes."""
    return min(24, max(14, round(math.log2(max(2, size)))))


def tables_for(bits: int, least: float) -> int:
    """Substrings that a code needs to find a pair at a cosine of ``least`` with a probability of ``RECALL``."""
    agree = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log1p(-agree))) if 0 < agree < 1 else TABLES


def learn_rotation(sample: np.ndarray, start: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Iterative quantisation: principal directions, then the rotation nearest to the signs it makes."""
    dim = sample.shape[1]
    width = min(dim, 64)
    basis = np.eye(dim)
    if len(sample) > dim:
        centred = sample - sample.mean(0)
        basis = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    projected = sample @ basis[:, :width]
    turn = np.linalg.qr(start.standard_normal((width, width)))[0]
    for _ in range(rounds if len(sample) > dim else 0):
        u, _, vt = np.linalg.svd(projected.T @ np.sign(projected @ turn))
        turn = u @ vt
    return basis[:, :width] @ turn


def encode(vectors: np.ndarray, rotations: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (n x tables, substring with its table's number) and a signature of up to 63 signs of its own."""
    signs = vectors @ rotations > 0
    weights = (1 << np.arange(bits, dtype=np.int64))[::-1]
    keys = np.empty((len(vectors), tables), np.int64)
    for t in range(tables):
        keys[:, t] = signs[:, t * bits : (t + 1) * bits] @ weights + (t << 40)
    own = signs[:, tables * bits :][:, :63]
    return keys, own @ (1 << np.arange(own.shape[1], dtype=np.int64))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length, neither of them zero, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def usable(vectors: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """``key, owner, vec, cls`` of the vectors that can have neighbours; ``cls`` is equal for equal vectors."""
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(
        F.col(key), F.col(group).alias("owner"), F.col(vector).alias("vec")
    )
    length = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.where((length > 0) & (length < F.lit(math.inf)))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.withColumn("cls", F.xxhash64("vec"))
    return rows.where(F.size("vec") == sizes[0]["d"]).withColumn("cls", F.xxhash64("vec"))


def _array_of(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 1))


def index_entries(classes: DataFrame, least: float, tables: int | None = None, bits: int | None = None) -> tuple[DataFrame, int]:
    """One row ``k, cls, sig`` per class and substring, in partitions by ``k`` of bounded size, and the number of classes."""
    size = classes.count()
    if not size:
        return classes.select(F.col("cls").alias("k"), "cls", F.col("cls").alias("sig")), 0
    drawn = F.pmod(F.xxhash64("cls", F.lit("sample")), F.lit(size)) < SAMPLE
    sample = classes.where(drawn).select("vec").collect() or classes.select("vec").limit(SAMPLE).collect()
    learned = np.array([r["vec"] for r in sample], np.float64)
    learned /= np.linalg.norm(learned, axis=1, keepdims=True)
    bits = bits or bits_for(size)
    tables = tables or tables_for(bits, least)
    width = min(learned.shape[1], 64)
    turns = [learn_rotation(learned, np.random.default_rng(seed)) for seed in range(-(-tables * bits // width) + -(-63 // width))]
    of_keys = -(-tables * bits // width)
    rotations = np.hstack([np.hstack(turns[:of_keys])[:, : tables * bits], *turns[of_keys:]]).astype(np.float32)
    shared = classes.sparkSession.sparkContext.broadcast(rotations)

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys, signature = encode(_array_of(batch["vec"]).astype(np.float32), shared.value, tables, bits)
                yield pd.DataFrame({"k": list(keys), "cls": batch["cls"], "sig": signature})

    coded = classes.select("cls", "vec").mapInPandas(codes, "k array<long>, cls long, sig long")
    parts = partitions_for(size * tables, 32, classes.sparkSession.sparkContext.defaultParallelism)
    return coded.select(F.explode("k").alias("k"), "cls", "sig").repartition(parts, "k"), size


def hot_buckets(entries: DataFrame, size: int, most: int = HOT) -> DataFrame | None:
    """Buckets ``k`` with more than about ``most`` classes, told from a share of all classes; None if there are none."""
    share = min(1.0, 200 / most)
    if size <= most:
        return None
    drawn = entries.where(F.pmod(F.xxhash64("cls", F.lit("hot")), F.lit(1_000_000)) < int(share * 1_000_000))
    hot = materialize(drawn.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0.8 * most * share).select("k"), "hot")
    return hot if hot.take(1) else None


def candidates(coded: DataFrame, radius: int = SIGNATURE_RADIUS) -> DataFrame:
    """Pairs of classes (a < b) that share a substring and whose signatures are near."""
    left, right = coded.select("k", F.col("cls").alias("a"), F.col("sig").alias("sa")), coded.select("k", F.col("cls").alias("b"), F.col("sig").alias("sb"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= radius)
    return left.hint("merge").join(right, "k").where(near).select("a", "b").distinct()


def nearest(
    vectors: DataFrame, key: str, group: str, vector: str, k: int, least: float, tables: int | None = None, bits: int | None = None, most: int = HOT
) -> DataFrame:
    """Up to ``k`` most similar keys of other groups with a cosine of at least ``least``: ``key, neighbour, similarity, position``."""
    rows = materialize(usable(vectors, key, group, vector), "vectors")
    classes = materialize(rows.groupBy("cls").agg(F.first("vec").alias("vec")), "classes")
    members = rows.groupBy("cls", key).agg(F.max("owner").alias("owner"))
    # representatives: at most k per group, 2k per class, smallest keys first
    per_group = members.withColumn("__n", F.row_number().over(Window.partitionBy("cls", "owner").orderBy(key))).where(F.col("__n") <= k)
    few = per_group.withColumn("__n", F.row_number().over(Window.partitionBy("cls").orderBy(key))).where(F.col("__n") <= 2 * k).drop("__n")
    few = materialize(few.withColumnRenamed(key, "other").withColumnRenamed("owner", "other_owner"), "representatives")
    entries, size = index_entries(classes, least, tables, bits)
    hot = hot_buckets(entries, size, most)
    crowd = None
    if hot is not None:
        crowd = materialize(entries.join(hot, "k", "left_semi").select("cls").distinct(), "crowd")
        entries = entries.join(hot, "k", "left_anti")
    found = candidates(entries)
    va = classes.select(F.col("cls").alias("a"), F.col("vec").alias("va"))
    vb = classes.select(F.col("cls").alias("b"), F.col("vec").alias("vb"))
    similar = found.join(va, "a").join(vb, "b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity"))
    similar = materialize(similar.where(F.col("similarity") >= least), "similar")
    both = (
        similar.select(F.col("a").alias("cls"), F.col("b").alias("near"), "similarity")
        .unionByName(similar.select(F.col("b").alias("cls"), F.col("a").alias("near"), "similarity"))
        .unionByName(few.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls", F.col("cls").alias("near"), F.lit(1.0).alias("similarity")))
    )
    offers = both.join(few.withColumnRenamed("cls", "near"), "near").drop("near")
    best = [F.desc("similarity"), F.col("other")]
    offers = offers.withColumn("__n", F.row_number().over(Window.partitionBy("cls", "other_owner").orderBy(*best))).where(F.col("__n") <= k)
    offers = offers.withColumn("__n", F.row_number().over(Window.partitionBy("cls").orderBy(*best))).where(F.col("__n") <= 2 * k)
    offers = offers.groupBy("cls").agg(F.collect_list(F.struct("similarity", "other", "other_owner")).alias("__offers"))
    listed = (
        members.join(offers, "cls")
        .select(F.col(key), "cls", "owner", F.explode("__offers").alias("o"))
        .where(~F.col("owner").eqNullSafe(F.col("o.other_owner")))
        .select(F.col(key), "cls", F.col("o.other").alias("neighbour"), F.col("o.similarity").alias("similarity"))
        .withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")))
        .where(F.col("position") <= k)
    )
    if crowd is None:
        return listed.drop("cls")
    of_crowd = rows.join(crowd.withColumn("asked", F.lit(True)), "cls", "left")
    scanned = _scan_all(of_crowd, F.col("asked"), key, k).where(F.col("similarity") >= least)
    return listed.join(crowd, "cls", "left_anti").drop("cls").unionByName(scanned)


def exact(vectors: DataFrame, queries: Column, key: str, group: str, vector: str, k: int) -> DataFrame:
    """The exact ``k`` nearest keys of other groups, however far, for the rows where ``queries`` holds, against all rows.

    Work is quadratic where all rows ask. Queries go to the tasks in blocks; each task keeps the best k per
    query of its rows, and only those are shuffled.
    """
    return _scan_all(usable(vectors, key, group, vector), queries, key, k)


def _scan_all(rows: DataFrame, queries: Column, key: str, k: int) -> DataFrame:
    rows = rows.withColumn("asked", F.coalesce(queries, F.lit(False))).groupBy(key).agg(
        F.max("owner").alias("owner"), F.first("vec").alias("vec"), F.first("cls").alias("cls"), F.max("asked").alias("asked")
    )
    own = F.xxhash64(F.coalesce(F.col("owner").cast("string"), F.lit("")), F.col("owner").isNull())
    rows = materialize(rows.select(key, "vec", "cls", "asked", own.alias("own"), F.xxhash64("cls", own).alias("ask")), "rows")
    # of equal vectors, k per group and 2k in all are as much as a top-k without the own group can use
    few = rows.select(key, "vec", "cls", "own").withColumn("__n", F.row_number().over(Window.partitionBy("cls", "own").orderBy(key))).where(F.col("__n") <= k)
    few = few.withColumn("__n", F.row_number().over(Window.partitionBy("cls").orderBy(key))).where(F.col("__n") <= 2 * k).select(key, "vec", "own")
    few = materialize(few, "representatives")
    asking = materialize(rows.where("asked").groupBy("ask").agg(F.first("vec").alias("vec"), F.first("own").alias("own")), "asking")
    blocks = -(-asking.count() // QUERY_BLOCK)
    kind = dict(rows.dtypes)[key]
    best = Window.partitionBy("ask").orderBy(F.desc("similarity"), "neighbour")
    found = rows.sparkSession.createDataFrame([], f"ask long, neighbour {kind}, similarity double, position int")
    for block in range(blocks):
        asked = asking.where(F.pmod(F.xxhash64("ask", F.lit("block")), F.lit(blocks)) == block).toArrow()
        if len(asked):
            shared = rows.sparkSession.sparkContext.broadcast((_unit(asked["vec"].to_pandas()), asked["ask"].to_numpy(), asked["own"].to_numpy()))
            offers = few.sortWithinPartitions(key).mapInPandas(_scanner(shared, key, k), f"ask long, neighbour {kind}, similarity double")
            offers = offers.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)
            found = found.unionByName(materialize(offers, "scanned"))
            shared.destroy()
    return rows.where("asked").select(key, "ask").join(found, "ask").select(key, "neighbour", "similarity", "position")


def _unit(column: pd.Series) -> np.ndarray:
    x = _array_of(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scanner(shared, key: str, k: int):
    """The best ``k`` of a task's rows, which come sorted by key, for every query of ``shared``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, asks, owns = shared.value
        rough = q.astype(np.float32)
        margin = 1e-7 * (q.shape[1] + 8)  # single precision errs by less
        best, place = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        names, base = [], 0
        for batch in batches:
            if not len(batch):
                continue
            x, own = _unit(batch["vec"]), batch["own"].to_numpy()
            near = x.astype(np.float32).T
            for at in range(0, len(q), 512):
                part = slice(at, at + 512)
                s = rough[part] @ near
                floor = best[part, -1]
                if base == 0 and len(x) >= k:
                    head = np.where(owns[part, None] == own[None, :1024], -np.inf, s[:, :1024])
                    floor = np.partition(head, -k, axis=1)[:, -k]
                i, j = np.nonzero(s >= (floor - 2 * margin).astype(np.float32)[:, None])
                other = owns[part][i] != own[j]
                i, j = i[other], j[other]
                i, j = _leading(i, j, s[i, j], k, 2 * margin)
                if len(i):
                    exactly = np.concatenate([np.einsum("ij,ij->i", q[at + i[a : a + 100_000]], x[j[a : a + 100_000]]) for a in range(0, len(i), 100_000)])
                    _merge(best[part], place[part], i, base + j, exactly)
            names.append(batch[key].to_numpy())
            base += len(x)
        if names:
            i, j = np.nonzero(place >= 0)
            yield pd.DataFrame({"ask": asks[i], "neighbour": np.concatenate(names)[place[i, j]], "similarity": best[i, j]})

    return scan


def _ranks(i: np.ndarray) -> np.ndarray:
    """Position from 0 within runs of equal values."""
    return np.arange(len(i)) - np.searchsorted(i, i)


def _leading(i: np.ndarray, j: np.ndarray, value: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """The entries of every query ``i`` that lie no more than ``slack`` below its k-th."""
    order = np.lexsort((-value, i))
    i, j, value = i[order], j[order], value[order]
    floor = np.full(i[-1] + 1 if len(i) else 0, -np.inf)
    last = _ranks(i) == k - 1
    floor[i[last]] = value[last]
    keep = value >= floor[i] - slack
    return i[keep], j[keep]


def _merge(best: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
    """Take the entries into the lists of the best, in place; ties go to the smaller place."""
    met = np.unique(i)
    i = np.concatenate((np.repeat(met, best.shape[1]), i))
    j, value = np.concatenate((place[met].ravel(), j)), np.concatenate((best[met].ravel(), value))
    order = np.lexsort((j, -value, i))
    i, j, value = i[order], j[order], value[order]
    rank = _ranks(i)
    keep = rank < best.shape[1]
    best[i[keep], rank[keep]], place[i[keep], rank[keep]] = value[keep], j[keep]
