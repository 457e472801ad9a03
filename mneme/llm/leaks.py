"""Evaluation texts leaking into training text: latent semantic retrieval, then exact checks.

Texts are streams of letters and digits, case ignored; terms are runs of ``GRAM`` of them. One pass
over the corpus keeps the places of the passages' terms (``term_hits``), whatever their number; the
document frequencies of TF-IDF and all later steps read these only. Passages are spread by hash over
groups of about ``GROUP``, and each group gets a latent space by a randomised SVD that is spread over
slices of ``SLICE`` passages: random projections of a slice's rows, their Gram matrices summed per group
to an orthonormal range, the term side of the slices in that range summed per term, and a small
factorisation of the sum. All groups are factorised in the same jobs.

A document's windows are projected into the space of every group whose terms it has and held against
the group's passages: a window is a candidate if its inner product with a passage reaches ``NEAR`` of
the least weight that a shared run of ``run`` characters can have in it, or ``PARAPHRASE`` of the
passage's own weight, whichever is less. The rank is that of the group's passages, so the space keeps
every inner product with them, and terms have positive weights: no verbatim leak is lost, however many
passages there are. Candidates are then checked: for a common run of at least ``run`` characters, and
otherwise for paraphrases, by the longest common subsequence with the passage in a span of about its
length and by the passage's figures, compared as numbers.

Windows of ``CELLS`` times the stride, one every stride, hold every run of up to ``CELLS - 1`` strides.
Null and empty texts and passages, and passages shorter than ``run``, leak nowhere. Repeated rows
count once. Documents may be of any length (they are read in stretches). What is sent to all tasks is a
table of at most ``2 ** MOST_BITS`` bits with up to ``EXACT_TERMS`` terms, then up to ``SENT`` bytes of latent
spaces at a time, several thousand passages, for one pass over the term hits each.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mneme.storage import broadcast_if_small, materialize, spread

GRAM = 8
RUN, STRIDE, CELLS = 50, 60, 3
#: Passages that share a latent space, passages of a slice, characters per passage (longer ones are cut with overlap).
GROUP, SLICE, LONGEST = 192, 64, 400
#: Random columns of a sketch beyond the greatest number of passages in a group.
SPARE = 16
#: Share of the least weight of a shared run, and of a passage's own weight, at which a window becomes a candidate.
NEAR, PARAPHRASE = 0.9, 0.3
#: Bits of the table of terms at most, and per term; terms that are sent along for an exact look-up.
MOST_BITS, BITS_PER_TERM, EXACT_TERMS = 30, 256, 1_000_000
#: Characters of a document that are held as arrays at once; bytes of latent spaces that are sent to all tasks at once.
STRETCH, SENT = 600_000, 64 << 20
#: Characters of several documents that are looked up at once.
TOGETHER = 100_000
#: What a paraphrase must share: of the passage's characters in order, within a span of so many times its length, and of its figures.
SUBSEQUENCE, SPAN, FIGURES = 0.8, 1.2, 0.8

_DROP = re.compile(r"[\W_]+")
_FIGURE = re.compile(r"\d+")
_U = np.uint64


def normal(text: str) -> str:
    return _DROP.sub("", text.lower())


#: Per code point, whether it is a letter or digit; made once per process.
_kept: list[np.ndarray] = []


def codes_of(text: str) -> np.ndarray:
    """The code points of ``normal(text)``."""
    if not _kept:
        _kept.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes[_kept[0][codes]]


def grams(stream: str | np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM characters (or code points), a power of two: runs are joined from two of half the length."""
    codes = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(stream, str) else stream
    h, width = codes.astype(_U), 1
    while width < GRAM:
        if len(h) <= width:
            return np.empty(0, _U)
        h = (h[:-width] ^ (h[:-width] >> _U(31))) * _U(0x9E3779B97F4A7C15) + h[width:] * _U(0xC2B2AE3D27D4EB4F)
        width *= 2
    return h ^ (h >> _U(32))


class TermTable:
    """Which terms of a stream are known: a table of their leading bits, then the sorted terms where these were sent along."""

    def __init__(self, bits: int, packed: bytes, terms: np.ndarray | None) -> None:
        self._shift, self._terms = _U(64 - bits), terms
        self._known = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)

    def __call__(self, streams: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and terms of every stream of code points, found in all of them at once."""
        lengths = np.fromiter(map(len, streams), np.int64, len(streams))
        begin = np.concatenate(([0], np.cumsum(lengths)))
        h = grams(np.concatenate(streams))
        at = np.flatnonzero(self._known[(h >> self._shift).view(np.int64)])
        of = np.searchsorted(begin, at, "right") - 1
        inside = at + GRAM <= begin[of + 1]  # not the runs that reach into the next stream
        at, of, h = at[inside], of[inside], h[at[inside]]
        if self._terms is not None and len(h):
            same = self._terms[np.minimum(np.searchsorted(self._terms, h), len(self._terms) - 1)] == h
            at, of, h = at[same], of[same], h[same]
        ends = np.searchsorted(of, np.arange(1, len(streams)))
        return list(zip(np.split((at - begin[of]).astype(np.int32), ends), np.split(h.view(np.int64), ends)))


#: Slots of the table that one task packs.
_PACKED = 1 << 18


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    flags = np.zeros(_PACKED, bool)
    flags[rows["slot"].to_numpy(np.int64) % _PACKED] = True
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "bits": [np.packbits(flags).tobytes()]})


def term_table(terms: DataFrame) -> tuple[int, bytes, np.ndarray | None]:
    """What :class:`TermTable` needs, from distinct ``term``; at most ``2 ** MOST_BITS`` bits."""
    terms = materialize(terms, "terms")
    n = terms.count()
    bits = min(MOST_BITS, max(18, int(n * BITS_PER_TERM - 1).bit_length()))
    if n <= EXACT_TERMS:
        exact = np.sort(terms.toArrow()["term"].to_numpy().view(_U))
        flags = np.zeros(1 << bits, bool)
        flags[(exact >> _U(64 - bits)).astype(np.int64)] = True
        return bits, np.packbits(flags).tobytes(), exact
    slots = terms.select(F.shiftrightunsigned("term", 64 - bits).alias("slot")).distinct().withColumn("block", F.floor(F.col("slot") / _PACKED))
    packed = bytearray((1 << bits) // 8)
    for r in slots.groupBy("block").applyInPandas(_packed, "block long, bits binary").collect():
        packed[r["block"] * _PACKED // 8 : (r["block"] + 1) * _PACKED // 8] = r["bits"]
    return bits, bytes(packed), None


# ---- a randomised SVD over slices


def signs(terms: np.ndarray, width: int) -> np.ndarray:
    """The random row of each term (terms x width, +1 or -1), the same wherever the term is met."""
    words = -(-width // 64)
    h = terms.view(_U)[:, None] + np.arange(1, words + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> _U(shift))) * _U(factor)
    h ^= h >> _U(31)
    return np.unpackbits(h.view(np.uint8), axis=1)[:, :width].astype(np.float32) * 2 - 1


def orthonormal_range(gram: np.ndarray) -> np.ndarray:
    """What turns sketches with this Gram matrix into orthonormal columns; directions without weight are left out."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > values[-1] * 1e-11
    return vectors[:, keep] / np.sqrt(values[keep])


def factor(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the term side ``b`` (terms x range) of a matrix: its right singular vectors and what takes a row in the range to its latent vector."""
    values, turn = np.linalg.eigh(b.T @ b)
    keep = values > values[-1] * 1e-12
    length = np.sqrt(values[keep])
    return (b @ turn[:, keep]) / length, turn[:, keep] * length


def randomised_svd(a: np.ndarray, rank: int, slices: int = 4) -> np.ndarray:
    """Right singular vectors (columns) of ``a``, as the distributed steps make them from slices of its rows."""
    drawn = signs(np.arange(1, a.shape[1] + 1, dtype=np.int64) * 7919, rank + SPARE).astype(np.float64)
    parts = [p.astype(np.float64) for p in np.array_split(a, slices)]
    basis = orthonormal_range(sum((p @ drawn).T @ (p @ drawn) for p in parts))
    return factor(sum(p.T @ (p @ drawn @ basis) for p in parts))[0]


class _Slice:
    """The weighted rows of some passages over the terms that they have."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.pids, order = rows["pid"].to_numpy(), [grams(s).view(np.int64) for s in rows["stream"]]
        self.terms = np.unique(np.concatenate(order))
        self.weights = np.zeros(len(self.terms))
        self.a, self.least, self.lengths = np.zeros((len(rows), len(self.terms))), np.empty(len(rows)), rows["stream"].str.len().to_numpy()
        for term, weight in zip(rows["terms"], rows["weights"]):
            self.weights[np.searchsorted(self.terms, term)] = weight
        span = RUN - GRAM + 1
        for i, term in enumerate(order):
            place = np.searchsorted(self.terms, term)
            np.add.at(self.a[i], place, self.weights[place])
            energy = np.concatenate(([0.0], np.cumsum(self.weights[place] ** 2)))
            self.least[i] = (energy[span:] - energy[:-span]).min()
        shown = np.minimum(1.0, CELLS * STRIDE / self.lengths)  # of a passage longer than a window, the part that fits in
        self.threshold = np.minimum(NEAR * self.least, PARAPHRASE * shown * (self.a**2).sum(1))

    def sketch(self, width: int) -> np.ndarray:
        return self.a @ signs(self.terms, width).astype(np.float64)


def latent_spaces(weighted: DataFrame, width: int) -> DataFrame:
    """``grp, model`` of every group, from passages ``grp, slice, pid, stream, terms, weights``."""

    def gram_of(rows: pd.DataFrame) -> pd.DataFrame:
        y = _Slice(rows).sketch(width)
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "slice": [rows["slice"].iloc[0]], "gram": [(y.T @ y).tobytes()]})

    def basis_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        total = sum(np.frombuffer(g).reshape(width, width) for g in rows["gram"])
        basis = orthonormal_range(total)
        return pd.DataFrame({"grp": rows["grp"], "slice": rows["slice"], "basis": [basis.tobytes()] * len(rows)})

    def term_side(rows: pd.DataFrame, basis: pd.DataFrame) -> pd.DataFrame:
        part = _Slice(rows)
        q = part.sketch(width) @ np.frombuffer(basis["basis"].iloc[0]).reshape(width, -1)
        made = {"terms": part.terms, "weights": part.weights, "b": part.a.T @ q, "q": q, "pids": part.pids, "threshold": part.threshold}
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "slice": [rows["slice"].iloc[0]], "part": [pickle.dumps(made)]})

    def space_of(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(p) for p in rows.sort_values("slice")["part"]]
        terms = np.unique(np.concatenate([p["terms"] for p in parts]))
        b, weights = np.zeros((len(terms), parts[0]["b"].shape[1])), np.zeros(len(terms))
        for p in parts:
            place = np.searchsorted(terms, p["terms"])
            b[place] += p["b"]
            weights[place] = p["weights"]
        vectors, turn = factor(b)
        model = {
            "terms": terms, "weights": weights.astype(np.float32), "vectors": vectors.astype(np.float16), "pids": np.concatenate([p["pids"] for p in parts]),
            "passages": np.vstack([p["q"] for p in parts]).dot(turn).astype(np.float32), "threshold": np.concatenate([p["threshold"] for p in parts]).astype(np.float32),
        }
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]], "least": [float(model["threshold"].min())], "model": [pickle.dumps(model)]})

    by = ["grp", "slice"]
    grams_ = weighted.groupBy(*by).applyInPandas(gram_of, "grp int, slice int, gram binary")
    bases = grams_.groupBy("grp").applyInPandas(basis_of, "grp int, slice int, basis binary")
    sides = weighted.groupBy(*by).cogroup(bases.groupBy(*by)).applyInPandas(term_side, "grp int, slice int, part binary")
    return materialize(sides.groupBy("grp").applyInPandas(space_of, "grp int, least double, model binary"), "spaces")


def near_windows(places: list[np.ndarray], terms: list[np.ndarray], model: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, passage and window numbers of the windows near a passage in the latent space; ``terms`` stand at ``places``, ascending, in every row."""
    sizes = np.fromiter(map(len, places), np.int64, len(places))
    at, term, row = np.concatenate(places).astype(np.int64), np.concatenate(terms), np.repeat(np.arange(len(places)), sizes)
    place = np.minimum(np.searchsorted(model["terms"], term), len(model["terms"]) - 1)
    known = model["terms"][place] == term
    at, place, row = at[known] // STRIDE, place[known], row[known]
    if not len(at):
        return
    # cells of all rows in one line, with a gap of CELLS between rows, so that no window reaches into the next one
    last = np.zeros(len(places), np.int64)
    np.maximum.at(last, row, at + CELLS)
    begin = np.concatenate(([0], np.cumsum(last + 1)[:-1]))
    cell = begin[row] + at
    weights = model["weights"][place]
    energy = np.bincount(cell, weights.astype(np.float64) ** 2, int(cell[-1]) + CELLS + 1)
    within = np.concatenate(([0.0], np.cumsum(energy)))
    windows = np.flatnonzero(within[CELLS:] - within[:-CELLS] >= model["threshold"].min() * 0.999)  # no lighter window can reach any passage
    of = np.searchsorted(begin, windows, "right") - 1
    windows = windows[windows - begin[of] <= last[of] - CELLS]  # not those that begin in a gap
    if not len(windows):
        return
    needed = np.zeros(len(energy) + 1, np.int64)
    for i in range(CELLS):
        needed[windows + i] = 1
    kept = needed[cell] > 0
    cell, place, weights = cell[kept], place[kept], weights[kept]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    slot = np.full(len(energy) + 1, len(first), np.int64)  # cells without terms share the last, empty, latent vector
    slot[cell[first]] = np.arange(len(first))
    latent = np.zeros((len(first) + 1, model["vectors"].shape[1]), np.float32)
    ends = np.append(first[1:], len(cell))
    at = 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(ends, first[at] + 8192, "right")))
        part = slice(first[at], ends[upto - 1])
        latent[at:upto] = np.add.reduceat(model["vectors"][place[part]] * weights[part, None], first[at:upto] - first[at])
        at = upto
    for some in np.array_split(windows, -(-len(windows) // 4096)):
        near = sum(latent[slot[some + i]] for i in range(CELLS)) @ model["passages"].T
        w, p = np.nonzero(near >= model["threshold"])
        if len(w):
            of = np.searchsorted(begin, some[w], "right") - 1
            yield of, p, some[w] - begin[of]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit in one big integer."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & places.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _stretches(stream: np.ndarray, stride: int) -> Iterator[tuple[int, np.ndarray]]:
    step = STRETCH - STRETCH % stride
    for base in range(0, max(1, len(stream)), step):
        yield base, stream[base : base + step + CELLS * stride]


def passages_of(cases: DataFrame, case: str, passage: str) -> DataFrame:
    """``case, stream, figures`` of every passage, cut to pieces of at most LONGEST characters."""
    kind = dict(cases.dtypes)[case]

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, whole in zip(batch["c"], batch["p"]):
                stream = normal(whole)
                for at in range(0, max(1, len(stream) - RUN + 1), LONGEST - RUN + 1):
                    piece = stream[at : at + LONGEST]
                    if len(piece) >= RUN:
                        rows.append((name, piece, sorted(figures_in(piece))))
            yield pd.DataFrame(rows, columns=["case", "stream", "figures"])

    rows = cases.where(F.col(case).isNotNull() & F.col(passage).isNotNull()).select(F.col(case).alias("c"), F.col(passage).alias("p")).distinct()
    return rows.mapInPandas(prepare, f"case {kind}, stream string, figures array<string>")


def figures_in(stream: str) -> set[str]:
    """The numbers of a stream, without leading zeros: a number is all the digits that stand together."""
    return {f.lstrip("0") or "0" for f in _FIGURE.findall(stream)}


def term_hits(docs: DataFrame, table: tuple[int, bytes, np.ndarray | None]) -> DataFrame:
    """``key, base, at, term`` of every stretch of a document (key, t) with known terms: their places from ``base`` on; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TermTable(*shared.value)
        for batch in batches:
            rows, waiting, held = [], [], 0
            for key, whole in zip(batch["key"], batch["t"]):
                for base, part in _stretches(codes_of(whole), STRIDE):
                    waiting.append((key, base, part))
                    held += len(part)
                if held > TOGETHER:
                    rows += [(key, base, at, term) for (key, base, _), (at, term) in zip(waiting, known([w[2] for w in waiting])) if len(at)]
                    waiting, held = [], 0
            if waiting:
                rows += [(key, base, at, term) for (key, base, _), (at, term) in zip(waiting, known([w[2] for w in waiting])) if len(at)]
            yield pd.DataFrame(rows, columns=["key", "base", "at", "term"])

    return materialize(spread(docs).mapInPandas(find, f"key {dict(docs.dtypes)['key']}, base int, at array<int>, term array<long>"), "hits")


def _weighted(units: DataFrame, hits: DataFrame, total: Column) -> DataFrame:
    """Passages with their distinct terms and TF-IDF weights, document frequencies counted over the whole corpus."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms = [np.unique(grams(s)).view(np.int64) for s in batch["stream"]]
            yield pd.DataFrame({"pid": np.repeat(batch["pid"].to_numpy(), [len(t) for t in terms]), "term": np.concatenate(terms) if terms else []})

    frequencies = hits.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a very long document counts once per stretch
    weight = F.log1p((total + 1) / (F.coalesce("df", F.lit(0)) + 1))
    pairs = units.mapInPandas(own, "pid long, term long").join(frequencies, "term", "left").select("pid", "term", weight.alias("w"))
    lists = pairs.groupBy("pid").agg(F.collect_list(F.struct("term", "w")).alias("l"))
    return materialize(units.join(lists, "pid").select("grp", "slice", "pid", "stream", F.col("l.term").alias("terms"), F.col("l.w").alias("weights")), "weighted")


def _candidates(hits: DataFrame, spaces: DataFrame) -> DataFrame:
    """``key, pid, base, cells`` of the windows near a passage: one pass over the hits per ``SENT`` bytes of latent spaces."""
    spark, schema = hits.sparkSession, f"key {dict(hits.dtypes)['key']}, pid long, base int, cells array<int>"
    running = F.sum(F.length("model")).over(Window.partitionBy(F.lit(0)).orderBy("grp"))  # one row per group of passages
    numbers = [(r["grp"], int(r["sent"] // SENT)) for r in spaces.select("grp", running.alias("sent")).collect()]
    found = spark.createDataFrame([], schema)
    for turn in sorted({n for _, n in numbers}):
        wanted = [g for g, n in numbers if n == turn]
        models = [r["model"] for r in spaces.where(F.col("grp").isin(wanted)).orderBy("grp").collect()]
        found = found.unionByName(hits.mapInPandas(_matcher(spark.sparkContext.broadcast(models)), schema))
    return found


def _matcher(shared: Broadcast):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [pickle.loads(m) for m in shared.value]
        for model in models:
            model["vectors"] = model["vectors"].astype(np.float32)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                keys, bases = part["key"].to_numpy(), part["base"].to_numpy()
                for model in models:
                    for row, p, window in near_windows(part["at"].tolist(), part["term"].tolist(), model):
                        found = pd.DataFrame({"row": row, "p": p, "cells": window.astype(np.int32)}).groupby(["row", "p"])["cells"].agg(list).reset_index()
                        yield pd.DataFrame({"key": keys[found["row"]], "pid": model["pids"][found["p"]], "base": bases[found["row"]], "cells": found["cells"]})

    return match


class _Checker:
    """Whether a passage stands in a stretch of a stream, word for word or nearly."""

    def __init__(self) -> None:
        self._runs: dict[str, set[str]] = {}

    def __call__(self, passage: str, figures: list[str], stream: str, base: int, cells: list[int]) -> tuple[bool, float, float]:
        if passage not in self._runs:
            if len(self._runs) > 20_000:
                self._runs.clear()
            self._runs[passage] = {passage[i : i + RUN] for i in range(len(passage) - RUN + 1)}
        runs = self._runs[passage]
        verbatim, order, share = False, 0.0, 0.0
        for first, last in _neighbours(sorted(cells)):
            start, stop = base + first * STRIDE, base + (last + CELLS) * STRIDE
            window = stream[start:stop]
            verbatim = verbatim or any(window[i : i + RUN] in runs for i in range(len(window) - RUN + 1))
            start, stop = max(0, start - len(passage)), stop + len(passage)
            while start and stream[start - 1].isdigit() and stream[start].isdigit():
                start -= 1
            around = stream[start:stop]
            there = figures_in(around)
            hit = sum(f in there for f in figures) / len(figures) if figures else 1.0
            share = max(share, hit)
            if passage in around:
                order = 1.0
            elif verbatim or hit >= FIGURES:
                order = max(order, self._in_order(passage, around))
        return verbatim, order, share

    @staticmethod
    def _in_order(passage: str, around: str) -> float:
        width, step = int(len(passage) * SPAN), max(1, len(passage) // 8)
        return max(common_subsequence(passage, around[i : i + width]) for i in range(0, max(1, len(around) - width + step), step)) / len(passage)


def _neighbours(cells: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of every run of cells whose windows touch."""
    first = last = cells[0]
    for cell in cells[1:]:
        if cell > last + CELLS:
            yield first, last
            first = cell
        last = cell
    yield first, last


def leaks(docs: DataFrame, key: str, text: str, cases: DataFrame, case: str, passage: str) -> DataFrame:
    """``case, key, verbatim, subsequence, figures, kind`` for every case and document that holds a passage of it."""
    kind_of_case, kind_of_key = dict(cases.dtypes)[case], dict(docs.dtypes)[key]
    spark = docs.sparkSession
    pieces = materialize(passages_of(cases, case, passage), "passages")
    units = pieces.groupBy("stream").agg(F.sort_array(F.collect_set("case")).alias("cases"), F.max("figures").alias("figures"))
    units = materialize(units.select(F.xxhash64("stream").alias("pid"), "stream", "cases", "figures"), "units")
    n = units.count()
    if not n:
        return spark.createDataFrame([], f"case {kind_of_case}, key {kind_of_key}, verbatim boolean, subsequence double, figures double, kind string")
    groups = -(-n // GROUP)
    placed = units.withColumn("grp", F.pmod("pid", F.lit(groups)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("pid"), F.lit(-(-GROUP // SLICE))).cast("int"))
    width = placed.groupBy("grp").count().agg(F.max("count")).first()[0] + SPARE

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"term": np.unique(np.concatenate([grams(s) for s in batch["stream"]])).view(np.int64)})

    texts = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"))
    hits = term_hits(texts, term_table(units.select("stream").mapInPandas(terms_of, "term long").distinct()))
    weighted = _weighted(placed, hits, F.lit(docs.where(F.col(text).isNotNull()).count()))
    found = materialize(_candidates(hits, latent_spaces(weighted, width)), "candidates")
    checks = found.join(units, "pid").groupBy("key").agg(F.collect_list(F.struct("stream", "cases", "figures", "base", "cells")).alias("checks"))
    checks = broadcast_if_small(materialize(checks, "checks"))  # where they are few, the texts need not move

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        checker = _Checker()
        for batch in batches:
            rows = []
            for name, whole, wanted in zip(batch["key"], batch["t"], batch["checks"]):
                stream = normal(whole)
                for c in wanted:
                    result = checker(c["stream"], list(c["figures"]), stream, int(c["base"]), list(c["cells"]))
                    rows += [(of, name, *result) for of in c["cases"]]
            yield pd.DataFrame(rows, columns=["case", "key", "verbatim", "subsequence", "figures"])

    schema = f"case {kind_of_case}, key {kind_of_key}, verbatim boolean, subsequence double, figures double"
    best = texts.join(checks, "key").mapInPandas(check, schema).groupBy("case", "key").agg(
        F.max("verbatim").alias("verbatim"), F.max("subsequence").alias("subsequence"), F.max_by("figures", "subsequence").alias("figures")
    )
    paraphrase = (F.col("subsequence") >= SUBSEQUENCE) & (F.col("figures") >= FIGURES)
    return best.withColumn("kind", F.when(F.col("verbatim"), "verbatim").when(paraphrase, "paraphrase")).where("kind is not null")
