"""Near-duplicate records with small edits: min-max hashing with banding.

A text is the set of its word runs (``run`` words in a row; words are runs of letters and digits,
case ignored). Under each of the hash permutations both the least and the greatest element are kept,
so half the evaluations give the same number of signature values, each of which agrees between two
sets with a probability equal to their Jaccard similarity. A band joins the two values of two
permutations; pairs of texts that share a band are candidates (1 - (1 - s^4)^bands of the pairs at
similarity s) and are then checked exactly on their sets, which are made again for the candidates
only. A sketch of one bit per signature value passes over pairs that are far below the similarity asked for
before that (five standard deviations). Band keys are spread over partitions of bounded size; the classes of one band are paired up in
blocks of ``BLOCK``, so a band that many different texts share is split over tasks, whatever its size.

Texts with equal sets are one class, so copies cost one entry of the index per task that reads them.
``every_pair`` expands them to all pairs of members. ``pairs_of`` is for large classes: of more than
``EXPANDED`` members the smallest that many and the first ones of two owners stand for the class, and
every other copy is linked to one of another owner in its own and in each linked class. Nulls, empty texts and texts of fewer than ``least_words`` words are near nothing; repeated
rows of a key count once; rows without key are left out; a null owner is an owner of its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mneme.storage import materialize, partitions_for, spread

BANDS, ROWS = 120, 4
#: Members that stand for a class of exact copies in the pairs.
EXPANDED = 64
#: Members of a class, and classes of a band, that a task pairs up at once.
BLOCK = 1000
#: Bits of a band's key; its number takes the bits above them.
KEY_BITS = 40

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hasher:
    """64-bit hashes of words, remembered for the words seen last."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        if len(self._known) > 500_000:
            self._known.clear()
        known = self._known
        return np.array([known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in found], _U)


def runs(hashes: np.ndarray, run: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``run`` words."""
    n = len(hashes) - run + 1
    if n < 1:
        return np.empty(0, _U)
    mixed = np.zeros(n, _U)
    for i in range(run):
        mixed = (mixed ^ (mixed >> _U(29))) * _U(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return np.unique(mixed ^ (mixed >> _U(32)))


def signature(sets: list[np.ndarray], bands: int, seed: int = 7) -> np.ndarray:
    """Band keys (sets x bands) of non-empty sets; two permutations with least and greatest make a band."""
    return _signatures(sets, bands, seed)[0]


def _signatures(sets: list[np.ndarray], bands: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and a sketch: one bit of every signature value, 64 to a number."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 63, (2 * bands, 2), dtype=np.uint64)
    shifts, factors = drawn[:, 0], drawn[:, 1] * _U(2) + _U(1)
    joined, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys, bits = np.empty((len(sets), bands), _U), np.zeros((len(sets), -(-ROWS * bands // 64) * 64), bool)
    for band in range(bands):
        key = np.full(len(sets), band + 1, _U)
        for i in (2 * band, 2 * band + 1):
            h = (joined ^ shifts[i]) * factors[i]
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            for k, value in enumerate((np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts))):
                key = (key ^ (key >> _U(31))) * _U(0xBF58476D1CE4E5B9) + value
                bits[:, 2 * i + k] = (value >> _U(17)) & _U(1)
        keys[:, band] = (key >> _U(64 - KEY_BITS)) + (_U(band) << _U(KEY_BITS))
    return keys.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def least_agreement(least: float, bands: int) -> int:
    """Bits of a sketch that two sets at a similarity of ``least`` have in common but with a probability of 3 in 10 million: five standard deviations below the mean."""
    n, p = ROWS * bands, (1 + least) / 2
    return max(0, math.floor(n * p - 5 * math.sqrt(n * p * (1 - p))))


def class_of(sets: list[np.ndarray]) -> np.ndarray:
    """One number per set, the same for equal sets."""
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], _U).view(np.int64)


def _sets(batches: Iterator[pd.DataFrame], least_words: int, run: int, step: int = 1000) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    hasher = _Hasher()
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.iloc[at : at + step]
            found = [words(t) for t in part["text"]]
            keep = [len(w) >= max(least_words, run) for w in found]
            if any(keep):
                yield part[keep], [runs(hasher(w), run) for w, k in zip(found, keep) if k]


def signed(texts: DataFrame, key: str, owner: str, text: str, least_words: int, run: int, bands: int) -> DataFrame:
    """``key, owner, cls, bands, sketch`` for every row with enough words; written once. The last two are null where the same task gave them for the class before."""
    kind, owner_kind = dict(texts.dtypes)[key], dict(texts.dtypes)[owner]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given: set[int] = set()
        for part, sets in _sets(batches, least_words, run):
            classes = class_of(sets)
            if len(given) > 1_000_000:
                given.clear()
            fresh = [i for i, c in enumerate(classes.tolist()) if c not in given and not given.add(c)]
            out, sketches = [None] * len(sets), [None] * len(sets)
            if fresh:
                for i, row, sketch in zip(fresh, *_signatures([sets[i] for i in fresh], bands)):
                    out[i], sketches[i] = row, sketch
            yield pd.DataFrame({"key": part["key"].to_numpy(), "owner": part["owner"].to_numpy(), "cls": classes, "bands": out, "sketch": sketches})

    rows = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(text).alias("text")
    )
    return materialize(spread(rows).mapInPandas(sign, f"key {kind}, owner {owner_kind}, cls long, bands array<long>, sketch array<long>"), "signed")


def banded_pairs(signed_rows: DataFrame, bands: int) -> DataFrame:
    """Pairs of classes (a < b) that share a band."""
    entries = signed_rows.where("bands is not null")
    parts = partitions_for(entries.count() * bands, 24, signed_rows.sparkSession.sparkContext.defaultParallelism, 32 << 20)
    # the filter is what the join below asks for anyway: with it in both branches they share one shuffle
    placed = entries.select("cls", F.explode("bands").alias("k")).where("k is not null").repartition(parts, "k")
    several = placed.groupBy("k").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most").select("k")
    shared = placed.join(several.hint("shuffle_hash"), "k").groupBy("k").agg(F.collect_set("cls").alias("c"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / BLOCK).cast("int")), lambda i: F.slice("c", i * BLOCK + 1, BLOCK))
    split = shared.select(blocks.alias("blocks")).select("blocks", F.posexplode("blocks").alias("i", "x"))
    met = split.select("x", F.explode(F.expr("slice(blocks, i + 1, size(blocks))")).alias("y")).repartition(parts, F.xxhash64("x", "y"))
    met = met.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y")).where("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_classes(texts: DataFrame, members: DataFrame, signed_rows: DataFrame, key: str, text: str, least: float, least_words: int, run: int, bands: int) -> DataFrame:
    """Pairs of classes (a < b) with their exact Jaccard similarity of at least ``least``."""
    met = materialize(banded_pairs(signed_rows, bands), "met")
    ends = met.select(F.col("a").alias("cls")).unionByName(met.select(F.col("b").alias("cls"))).distinct()
    sketches = signed_rows.where("sketch is not null").select("cls", "sketch").join(ends, "cls", "left_semi").groupBy("cls").agg(F.first("sketch").alias("sketch"))
    sketches = materialize(sketches, "sketches")
    x, y = sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"))
    width = -(-ROWS * bands // 64) * 64  # what is over in the last number agrees always
    differing = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    agreeing = F.lit(width) - differing - (width - ROWS * bands)
    pairs = materialize(met.join(x, "a").join(y, "b").where(agreeing >= least_agreement(least, bands)).select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    # written, so that its size is known: where it is small, the texts stay where they are
    first = materialize(members.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("key").alias("key")), "first")

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, sets in _sets(batches, least_words, run):
            own = part["cls"].to_numpy() == class_of(sets)  # a key may be repeated with another text
            yield pd.DataFrame({"cls": part["cls"].to_numpy()[own], "items": [s.view(np.int64) for s, o in zip(sets, own) if o]})

    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(first, "key")
    sets = materialize(rows.dropDuplicates(["cls", "text"]).mapInPandas(again, "cls long, items array<long>"), "sets")
    a, b = sets.select(F.col("cls").alias("a"), F.col("items").alias("ia")), sets.select(F.col("cls").alias("b"), F.col("items").alias("ib"))
    shared = F.size(F.array_intersect("ia", "ib"))
    jaccard = shared / (F.size("ia") + F.size("ib") - shared)
    return pairs.join(a, "a").join(b, "b").select("a", "b", jaccard.alias("similarity")).where(F.col("similarity") >= least)


def near_duplicates(
    texts: DataFrame, key: str, owner: str, text: str = "text", least: float = 0.8, least_words: int = 5, run: int = 5, bands: int = BANDS
) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, owner, cls) of all texts and ``links`` (a, b, similarity) between classes."""
    rows = signed(texts, key, owner, text, least_words, run, bands)
    members = rows.groupBy("key").agg(F.max(F.struct("cls", "owner")).alias("m")).select("key", "m.owner", "m.cls")
    members = materialize(members, "members")
    return members, materialize(similar_classes(texts, members, rows, key, text, least, least_words, run, bands), "links")


def _numbered(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that have a pair, with their number ``n`` in their class, and all links, those of a class to itself included."""
    shared = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    linked = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).unionByName(shared).distinct()
    numbered = members.join(linked, "cls", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("key")))
    itself = shared.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity"))
    return materialize(numbered, "numbered"), links.select("a", "b", "similarity").unionByName(itself)


def every_pair(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of keys of different owners, smaller key first: ``a, b, similarity``.

    Classes meet in blocks of ``BLOCK`` members, so no task gets all pairs of a large class.
    """
    numbered, joined = _numbered(members, links)
    numbered = numbered.withColumn("block", F.floor((F.col("n") - 1) / BLOCK).cast("int"))
    blocks = numbered.groupBy("cls").agg(F.max("block").alias("last"))
    items = joined.join(blocks.select(F.col("cls").alias("a"), F.col("last").alias("la")), "a").join(blocks.select(F.col("cls").alias("b"), F.col("last").alias("lb")), "b")
    items = items.select("a", "b", "similarity", "lb", F.explode(F.sequence(F.lit(0), "la")).alias("pa"))
    items = items.select("a", "b", "similarity", "pa", F.explode(F.sequence(F.lit(0), "lb")).alias("pb")).where("a <> b or pa <= pb")
    x = numbered.select(F.col("cls").alias("a"), F.col("block").alias("pa"), F.col("key").alias("ka"), F.col("owner").alias("oa"))
    y = numbered.select(F.col("cls").alias("b"), F.col("block").alias("pb"), F.col("key").alias("kb"), F.col("owner").alias("ob"))
    pairs = items.join(x, ["a", "pa"]).join(y, ["b", "pb"]).where(~F.col("oa").eqNullSafe(F.col("ob")) & (F.expr("a <> b") | (F.col("ka") < F.col("kb"))))
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity")


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of keys of different owners that link every copy, smaller key first: ``a, b, similarity``."""
    numbered, joined = _numbered(members, links)
    # the first keys of two owners: one of them has another owner than any given copy
    first = numbered.groupBy("cls", "owner").agg(F.min("key").alias("key")).withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("key"))).where("n <= 2")
    ends = joined.unionByName(joined.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    few, rest = numbered.where(F.col("n") <= EXPANDED), numbered.where(F.col("n") > EXPANDED)

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        x = left.select(F.col("cls").alias("a"), F.col("key").alias("ka"), F.col("owner").alias("oa"))
        y = right.select(F.col("cls").alias("b"), F.col("key").alias("kb"), F.col("owner").alias("ob"))
        return ends.join(x, "a").join(y, "b").where(~F.col("oa").eqNullSafe(F.col("ob"))).select(
            F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity"
        )

    return met(few, few).unionByName(met(rest, first)).distinct()


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """Connected groups: ``key, owner, group, n_links``; ``group`` is the smallest key of the group, ``n_links`` the number of different texts that the row's text is linked to.

    Classes take the least label among their neighbours and then that label's own label (pointer
    jumping), so the number of rounds grows with the logarithm of the longest chain; every round is
    written to the shared folder. Texts without a near copy are groups of their own.
    """
    edges = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    edges = materialize(edges, "edges")
    labels = materialize(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        offered = edges.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("offer"))
        lower = labels.join(offered, "x").select("x", F.least("label", "offer").alias("label"), F.col("label").alias("old"))
        of_label = lower.select(F.col("x").alias("label"), F.col("label").alias("beyond"))
        jumped = lower.join(of_label, "label", "left").select("x", F.coalesce(F.least("label", "beyond"), F.col("label")).alias("label"), "old")
        jumped = materialize(jumped, "labels")
        labels = jumped.select("x", "label")
        if not jumped.where("label <> old").take(1):
            break
    degree = edges.groupBy(F.col("x").alias("cls")).agg(F.count(F.lit(1)).alias("n_links"))
    labelled = members.join(labels.withColumnRenamed("x", "cls"), "cls", "left").join(degree, "cls", "left")
    labelled = materialize(labelled.select("key", "owner", F.coalesce("label", "cls").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "labelled")
    names = labelled.groupBy("label").agg(F.min("key").alias("group"))
    return labelled.join(names, "label").select("key", "owner", "group", "n_links")
