"""Splitting oversized items at natural boundaries.

Every position of a text has a boundary strength (heading > blank line > line > sentence > clause >
blank > anywhere; never inside a character with its combining marks). A sparse table answers "the
strongest boundary between two positions" in constant time, ties broken to the right. A piece ends
at the strongest boundary at a length of half the limit up to the limit; the next one starts at the
strongest boundary between half the overlap and the whole overlap before that end.

Nulls have no pieces; an empty text, or one of white space only, has none either. Texts of any
length are cut in one pass, with the table built for a stretch of bounded length at a time. Repeated
rows give repeated pieces; columns that are not asked for are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 2800, 400
#: Blanks, tabs and line breaks at either end do not count as text.
BLANKS = " \t\r\n"
#: Characters for which a sparse table is built at once.
STRETCH = 1 << 20

_STRENGTHS = (
    (1, re.compile(r"[ \t\u00a0\u3000]+(?=[^ \t\u00a0\u3000])")),
    (2, re.compile(r"[,;:)\]][ \t]+|[，、；：،؛]")),
    (3, re.compile(r"[.!?…؟।]+[\"'”“»)\]]*[ \t]+|[。！？]+[」』”）]*")),
    (4, re.compile(r"\r?\n")),
    (5, re.compile(r"\r?\n[ \t]*(?:\r?\n)+")),
    (6, re.compile(r"\n(?=#{1,6}[ \t])")),
)
_INSEPARABLE = re.compile(r"[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٟऀ-ःऺ-ॏ‍︀-️⃐-⃿]|(?<=‍).|(?<=\r)\n")


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..len(text)."""
    out = np.zeros(len(text) + 1, np.int8)
    for strength, pattern in _STRENGTHS:
        at = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        out[at] = np.maximum(out[at], strength)
    out[np.fromiter((m.start() for m in _INSEPARABLE.finditer(text)), np.int64)] = -1
    return out


class StrongestCut:
    """Sparse table for range maxima, built up to the longest range that is ever asked for."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self._values = values
        self._levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= min(longest, len(values)):
            low = self._levels[-1]
            a, b = low[:-width], low[width:]
            self._levels.append(np.where(values[a] > values[b], a, b))
            width *= 2

    def between(self, low: int, high: int) -> int:
        """Position of the greatest value in ``low..high``, both included; the rightmost of equals."""
        level = (high - low + 1).bit_length() - 1
        a, b = self._levels[level][low], self._levels[level][high + 1 - (1 << level)]
        return int(a if self._values[a] > self._values[b] else b)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of ``text`` as start and end, without the blanks at either end of the text."""
    if limit < 4 or not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit, the limit at least 4")
    at = len(text) - len(text.lstrip(BLANKS))
    stop = len(text.rstrip(BLANKS))
    pieces: list[tuple[int, int]] = []
    table, base, reach = None, 0, -1
    while stop - at > limit:
        if at + limit > reach:
            base, reach = at, min(len(text), at + max(STRETCH, 4 * limit))
            values = strengths(text[base:reach])
            if reach < len(text):
                values[-1] = 0
            table = StrongestCut(values, limit)
        end = base + table.between(at + limit // 2 - base, at + limit - base)
        pieces.append((at, end))
        at = base + table.between(end - overlap - base, end - overlap // 2 - base) if overlap else end
    if at < stop:
        pieces.append((at, stop))
    return pieces


def split(
    items: DataFrame,
    keys: list[str],
    carry: list[str],
    text: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    only_oversized: bool = False,
) -> DataFrame:
    """Pieces of every item: ``keys, carry, piece, n_pieces, start_char, end_char, piece_text``.

    Items within the limit come out whole without leaving the JVM, or not at all with
    ``only_oversized``; only the others reach Python.
    """
    made = ("piece", "n_pieces", "start_char", "end_char", "piece_text")
    if set(made) & {*keys, *carry}:
        raise ValueError(f"keys and carried columns can't be named {made}")
    rows = items.select(*keys, *carry, F.col(text).alias("piece_text")).withColumn(
        "__n", F.length(F.regexp_replace("piece_text", r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    )
    kept = [*keys, *carry]
    schema = T.StructType(
        [rows.schema[c] for c in kept]
        + [T.StructField(c, T.IntegerType()) for c in made[:4]]
        + [T.StructField("piece_text", T.StringType())]
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows_of, made_of = [], []
            for i, whole in enumerate(batch["piece_text"]):
                found = cut(whole, limit, overlap)
                rows_of += [i] * len(found)
                made_of += [(k + 1, len(found), a, b, whole[a:b]) for k, (a, b) in enumerate(found)]
            out = batch[kept].iloc[rows_of].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(made_of, columns=list(made))], axis=1)

    over = rows.where(F.col("__n") > limit).drop("__n").mapInPandas(pieces, schema)
    if only_oversized:
        return over
    whole = rows.where((F.col("__n") > 0) & (F.col("__n") <= limit))
    start = F.length("piece_text") - F.length(F.regexp_replace("piece_text", r"^[ \t\r\n]+", ""))
    fitting = whole.select(
        *kept, F.lit(1).alias("piece"), F.lit(1).alias("n_pieces"), start.alias("start_char"),
        (start + F.col("__n")).alias("end_char"),
        F.regexp_replace("piece_text", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("piece_text"),
    )
    return fitting.unionByName(over)
