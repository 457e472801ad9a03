"""Late chunking: what it gives for odd chunks, and that tokens stay where they are encoded."""

import time
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from mneme import models
from mneme.operators import chunking, embedding
from mneme.plans import details
from mneme.storage import shared_dir, table
from tests.conftest import DATA


def late(spark, rows, encoder=models.word_tokens, limit=100):
    df = spark.createDataFrame(rows, "key string, file string, pos int, text string")
    out = embedding.embed_late(df, "key", "file", "pos", F.col("text"), encoder, models.CHARACTER_TOKENS, limit).collect()
    assert sorted(r["key"] for r in out) == sorted(r[0] for r in rows)  # every chunk once
    return {r["key"]: r for r in out}


def test_tokens_are_not_written(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before, texts = held(), table(spark, DATA, "chunks", "text").agg(F.sum(F.octet_length("text"))).first()[0]
    assert details.late_chunks(spark, DATA).count() > 0
    assert held() - before < texts


def test_chunks_in_one_place_are_encoded_once(spark):
    got = late(spark, [("b", "f", 0, "dach"), ("a", "f", 0, "haus garten"), ("c", "f", 1, "keller"), ("x", None, 0, "wort"), ("y", "f", None, "wort")])
    assert {k: r["colbert"] and len(r["colbert"]) for k, r in got.items()} == {"a": 2, "b": 1, "c": 1, "x": None, "y": None}
    word = np.array(models.word_tokens("dach")[0].vector)
    assert np.allclose(got["b"]["dense"], word / np.linalg.norm(word), atol=1e-6)


def test_windows_special_tokens_and_bare_chunks(spark):
    seen = lambda text: [models.Token(0, 0, 9, 1.0, [9.0, 9.0])] + [models.Token(t.start, t.end, len(text), t.weight - 2 * (t.weight < 0.5), [float(len(text)), 1.0]) for t in models.word_tokens(text)]
    got = late(spark, [("a", "f", 0, "eins zwei"), ("b", "f", 1, None), ("c", "f", 2, "--"), ("d", "f", 3, "drei " * 10), ("e", "g", 0, ""), ("h", "g", 1, "-")], seen, 10)
    joined, alone = len("eins zwei\n\n--"), len("drei " * 10)
    assert {k: r["colbert"] and (r["colbert"][0], len(r["colbert"])) for k, r in got.items()} == {
        "a": ([joined, 1], 2), "b": ([joined, 1], 2), "c": ([joined, 1], 2), "d": ([alone, 1], 10), "e": None, "h": None,
    }
    weights = {k: max(t.weight for t in seen(text)[1:]) for k, text in (("a", "eins zwei"), ("d", "drei"))}
    for k, number in (("a", joined), ("d", alone)):
        assert [*(got[k]["sparse"] or {})] == [number] * (weights[k] > 0)


def test_a_file_of_many_chunks_is_folded_in_proportion(spark):
    sizes = spark.range(60_000).select(F.lit("f").alias("file"), F.col("id").alias("n"), (F.col("id") % 7).alias("t"))
    began = time.time()
    got = chunking.pack_windows(sizes, "file", "n", F.when(F.col("t") != 6, F.col("t")).otherwise(20), 10).groupBy("window").agg(F.sum("t").alias("s"), F.count(F.lit(1)).alias("c")).collect()
    assert time.time() - began < 20  # about 2; 76 with a copy of the list at every step
    held = Counter((r["s"], r["c"]) for r in got)
    assert held == {(0, 1): 8572, (10, 4): 8571, (5, 1): 8571, (6, 1): 8571, (3, 2): 1}  # 0, 1 to 4, 5, 6 counted as 20; three rows are left
    assert chunking.fold_windows([None, 3, 700, 3, None, 4], 600) == [1, 1, 2, 3, 3, 3]
