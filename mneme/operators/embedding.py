"""Embedding chunks: each on its own, or late, out of one pass over a window of consecutive chunks.

Late chunking encodes a window's tokens once, with all the window as context, and gives every chunk
the tokens that overlap it: their mean at length one, the greatest weight of every token id, and
their vectors in order. A window holds a bounded number of tokens (``chunking.window_numbers``), so the
lists of a chunk are bounded, too; tokens are pooled where they are encoded, so that they are neither
written nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mneme import models
from mneme.operators import chunking
from mneme.storage import materialize

#: What stands between two chunks of a window.
BETWEEN = "\n\n"
#: What late chunking makes, with types.
PARTS = {"dense": "array<float>", "sparse": "map<int,float>", "colbert": "array<array<float>>"}
#: Coordinates of token vectors after which a batch of chunks leaves Python.
BATCH = 1 << 20


def window_chunks(chunks: DataFrame, key: str, file: str, order: str, text: Column, tokens: models.TokenCounter, limit: int = chunking.WINDOW_TOKENS) -> DataFrame:
    """``keys, texts`` of every window: its chunks in order, those in one place by key. Chunks without a key, a file or a place are in none."""
    rows = chunks.select(F.col(key).alias("key"), F.col(file).alias("file"), F.col(order).alias("order"), text.alias("text")).where("key is not null and file is not null and `order` is not null")
    sizes = rows.select("file", F.struct("order", "key").alias("at"), tokens.column(F.col("text")).alias("t"))
    numbers = chunking.window_numbers(sizes, "file", "at", F.coalesce("t", F.lit(0)), limit).select(F.col("at.key").alias("key"), "window")
    held = rows.join(numbers, "key").groupBy("file", "window").agg(F.array_sort(F.collect_list(F.struct("order", "key", "text"))).alias("c"))
    return held.select(F.col("c.key").alias("keys"), F.col("c.text").alias("texts"))


def pool_window(texts: Sequence[str | None], encoder: models.TokenEncoder, parts: Sequence[str]) -> Iterator[list]:
    """The ``parts`` of each chunk of one window, in order. Special tokens end at 0 and belong nowhere; a chunk without
    any token gets all content tokens of its window, and nulls where there are none."""
    content = [t for t in encoder(BETWEEN.join(t for t in texts if t is not None)) if t.end > 0]
    starts, ends = np.array([t.start for t in content]), np.array([t.end for t in content])
    vectors = np.array([t.vector for t in content], float) if {"dense", "colbert"} & set(parts) else None

    def dense(own: np.ndarray) -> np.ndarray:
        total = vectors[own].sum(axis=0)
        length = np.sqrt((total * total).sum())
        return (total if length == 0 else total / length).astype(np.float32)

    def sparse(own: np.ndarray) -> dict[int, float] | None:
        best: dict[int, float] = {}
        for t in (content[i] for i in own):
            if t.weight is not None and (t.weight > best.get(t.number, 0.0) or t.weight != t.weight):
                best[t.number] = t.weight
        return best or None

    make = {"dense": dense, "sparse": sparse, "colbert": lambda own: list(vectors[own].astype(np.float32))}
    at = 0
    for text in texts:
        own = np.empty(0, int)
        if text is not None:
            own = np.flatnonzero((starts < at + len(text)) & (ends > at))
            at += len(text) + len(BETWEEN)
        own = own if len(own) else np.arange(len(content))
        yield [make[p](own) if len(own) else None for p in parts]


def late_encodings(
    chunks: DataFrame, key: str, file: str, order: str, text: Column, encoder: models.TokenEncoder, tokens: models.TokenCounter,
    limit: int = chunking.WINDOW_TOKENS, parts: Sequence[str] = tuple(PARTS),
) -> DataFrame:
    """``key`` and the ``parts`` of every chunk that is in a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for keys, texts in zip(batch["keys"], batch["texts"]):
                for k, made in zip(keys, pool_window(texts, encoder, parts)):
                    rows.append((k, *made))
                    held += sum(len(m) * (len(m[0]) if p == "colbert" else 1) for p, m in zip(parts, made) if m is not None)
                    if held >= BATCH:
                        yield pd.DataFrame(rows, columns=[key, *parts])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=[key, *parts])

    windows = window_chunks(chunks, key, file, order, text, tokens, limit)
    schema = ", ".join([f"`{key}` {chunks.schema[key].dataType.simpleString()}", *[f"{p} {PARTS[p]}" for p in parts]])
    return materialize(windows.mapInPandas(run, schema), "late")


def embed_late(chunks: DataFrame, key: str, file: str, order: str, text: Column, encoder: models.TokenEncoder, tokens: models.TokenCounter, limit: int = chunking.WINDOW_TOKENS) -> DataFrame:
    """``chunks`` with ``dense``, ``sparse`` and ``colbert`` out of their windows; a chunk without tokens in a window without any has nulls."""
    return chunks.join(late_encodings(chunks, key, file, order, text, encoder, tokens, limit), key, "left")


def embed_chunks(
    chunks: DataFrame, key: str, file: str, order: str, text: Column, encoder: models.Encoders | models.Encoder | None = None,
    late: models.TokenEncoder | None = None, tokens: models.TokenCounter = models.CHARACTER_TOKENS,
) -> DataFrame:
    """``chunks`` with their three encodings: late with an encoder of tokens, else each chunk on its own."""
    if late is not None:
        return embed_late(chunks, key, file, order, text, late, tokens)
    return models.encode_all(chunks, text, encoder)
