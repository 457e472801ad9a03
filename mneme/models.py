"""Pluggable models with deterministic built-ins.

Neural encoders, cross-encoders and language models are interfaces here. The built-ins need no
network and no GPU, so that every plan can run and be tested; they make no claim to quality.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters per token of the usual encoder, and of prompts in the cost model.
CHARS_PER_TOKEN, COST_CHARS_PER_TOKEN = 3.1, 3.5


@dataclass(frozen=True)
class TokenCounter:
    """Counts tokens on both sides of the engine; the two must agree."""

    column: Callable[[Column], Column]
    python: Callable[[str], int]


CHARACTER_TOKENS = TokenCounter(
    lambda c: F.ceil(F.length(c) / F.lit(CHARS_PER_TOKEN)).cast("int"), lambda t: math.ceil(len(t) / CHARS_PER_TOKEN)
)


class Encoder(Protocol):
    """Dense vectors of unit length for a batch of texts; created once per Python worker."""

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEncoder:
    """Words hashed to signed coordinates, summed and normalised."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                out[i, h % self.width] += 1.0 if h >> 63 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _digest(word: str) -> bytes:
    return hashlib.md5(word.encode()).digest()


def sparse_weights(text: str) -> dict[int, float]:
    """Weight of every word, by a hashed id: one plus the logarithm of its count."""
    counts: dict[int, int] = {}
    for word in re.findall(r"\w+", (text or "").lower()):
        token = int.from_bytes(_digest(word)[:4], "little") % (1 << 20)
        counts[token] = counts.get(token, 0) + 1
    return {t: 1.0 + math.log(n) for t, n in counts.items()}


def token_vectors(text: str, width: int = 16) -> list[list[float]]:
    """One unit vector per word; ``index.build_points`` refuses a chunk with more than the store takes."""
    out = []
    for word in re.findall(r"\w+", (text or "").lower()):
        v = np.frombuffer(_digest(word) + _digest(word + "+"), np.uint8)[:width].astype(float) - 127.5
        out.append((v / np.linalg.norm(v)).tolist())
    return out


@dataclass(frozen=True)
class Encoders:
    """The three encodings of a text, as one model or three give them; each can be replaced."""

    dense: Encoder = HashingEncoder()
    sparse: Callable[[str], dict[int, float]] = sparse_weights
    tokens: Callable[[str], list[list[float]]] = token_vectors


def encode_all(df: DataFrame, text: Column, encoder: Encoders | Encoder | None = None) -> DataFrame:
    """``df`` with ``dense``, ``sparse`` and ``colbert``; built-in encoders where none are given."""
    models = encoder if isinstance(encoder, Encoders) else Encoders(encoder or HashingEncoder())

    @F.pandas_udf("map<int,float>")
    def sparse(texts: pd.Series) -> pd.Series:
        return texts.map(models.sparse)

    @F.pandas_udf("array<array<float>>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(models.tokens)

    rows = encode(df.withColumn("__text", text), "__text", models.dense)
    return rows.withColumn("sparse", sparse("__text")).withColumn("colbert", tokens("__text")).drop("__text")


@dataclass(frozen=True)
class Token:
    """A token of a long text as one forward pass gives it: place, id, weight and vector."""

    start: int
    end: int
    number: int
    weight: float
    vector: list[float]


class TokenEncoder(Protocol):
    """All tokens of a text, each in the context of the whole."""

    def __call__(self, text: str) -> list[Token]: ...


@lru_cache(1 << 14)
def _word_token(word: str, width: int) -> tuple[int, float, list[float]]:
    """Id, weight and vector of a word; the list is shared by its tokens."""
    digest = _digest(word)
    v = np.frombuffer(digest, np.uint8)[:width].astype(float) - 127.5
    return int.from_bytes(digest[:3], "big"), digest[3] / 255, v.tolist()


def word_tokens(text: str, width: int = 16) -> list[Token]:
    """A stand-in: words, with ids, weights and vectors from their digests, whatever the context."""
    return [Token(m.start(), m.end(), *_word_token(m[0], width)) for m in re.finditer(r"\w+", text.lower())]


class Scorer(Protocol):
    """Relevance in 0..1 of passages for a query, in batches."""

    def __call__(self, queries: Sequence[str], passages: Sequence[str]) -> Sequence[float]: ...


def overlap_scorer(queries: Sequence[str], passages: Sequence[str]) -> list[float]:
    """Share of the query's distinct words that the passage has."""
    out = []
    for query, passage in zip(queries, passages):
        asked = set(re.findall(r"\w+", (query or "").lower()))
        out.append(len(asked & set(re.findall(r"\w+", (passage or "").lower()))) / len(asked) if asked else 0.0)
    return out


class Judge(Protocol):
    """Raw judgements for a batch of prompts; see :func:`mneme.operators.evaluation.judge_label`."""

    def __call__(self, prompts: Sequence[str]) -> Sequence[str]: ...


class Generator(Protocol):
    """Answers for a batch of prompts."""

    def __call__(self, prompts: Sequence[str]) -> Sequence[str]: ...


def echo_generator(prompts: Sequence[str]) -> list[str]:
    """A stand-in for a language model: the prompt's length and digest."""
    return [f"{len(p)} {hashlib.sha256(p.encode()).hexdigest()[:16]}" for p in prompts]


def encode(df: DataFrame, text: str, encoder: Encoder, out: str = "dense", batch: int = 32) -> DataFrame:
    """``df`` with a vector column, encoded in Arrow batches cut to the model's batch size."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        parts = [encoder(texts.iloc[i : i + batch].tolist()) for i in range(0, len(texts), batch)]
        return pd.Series([row.astype(np.float32) for part in parts for row in part])

    return df.withColumn(out, run(F.col(text)))


def score(df: DataFrame, query: Column, passage: Column, scorer: Scorer, out: str = "relevance") -> DataFrame:
    @F.pandas_udf("double")
    def run(queries: pd.Series, passages: pd.Series) -> pd.Series:
        return pd.Series(scorer(queries.tolist(), passages.tolist()), dtype=float)

    return df.withColumn(out, run(query, passage))


def generate(df: DataFrame, prompt: Column, generator: Generator, out: str = "answer") -> DataFrame:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(list(generator(prompts.tolist())))

    return df.withColumn(out, run(prompt))
