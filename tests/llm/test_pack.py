import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mneme.llm import pack as pk


def best_sum(sizes, room):
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums if x + s <= room}
    return max(sums)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=14))
@settings(max_examples=120, deadline=None)
def test_every_container_is_the_fullest_possible(sizes):
    numbers = pk.fill(sizes, 30)
    left = dict(enumerate(sizes))
    for c in range(max(numbers) + 1):
        mine = [i for i, n in enumerate(numbers) if n == c]
        largest = max(left.values())
        rest = sorted(left.values())
        rest.remove(largest)
        assert sum(left[i] for i in mine) == largest + best_sum(rest, 30 - largest) and largest in [left[i] for i in mine]
        for i in mine:
            del left[i]
    assert not left


def test_cuts_keep_characters_whole():
    text = ("aé日😀" * 50).encode()
    pieces = pk.cut_bytes(text, 33)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b == c for (_, b), (c, _) in zip(pieces, pieces[1:]))
    assert all(0 < b - a <= 33 for a, b in pieces) and "".join(text[a:b].decode() for a, b in pieces) == text.decode()


def test_operator_packs_tightly_over_several_blocks(spark):
    rng = random.Random(2)
    data = [(i, "x" * min(1000, int(rng.lognormvariate(4, 1)) + 1)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, text string")
    out = pk.pack(df, "id", capacity=1000, block_containers=40).collect()
    load = {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    total = sum(len(t) for _, t in data)
    assert len(out) == 3000 and sum(load.values()) == total and max(load.values()) <= 1000
    assert len(load) <= -(-total // 1000) + 2


def test_edge_cases(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "é" * 30, "x"), (3, "é" * 30, "x"), (4, "a", "x"), (None, "z" * 70, "x"), (5, "b" * 25, "x")]
    df = spark.createDataFrame(data, "id long, text string, container string")
    out = pk.pack(df, "id", capacity=25).collect()
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append((r["piece"], r["n_pieces"], r["tokens"], r["container"]))
    assert by[1] == by[2] == [(1, 1, 0, None)] and len(by[3]) == 6 and None not in by and len(by[5]) == 1
    assert all(t <= 25 for v in by.values() for _, _, t, _ in v)
    empty = pk.pack(df.limit(0), "id")
    assert empty.count() == 0
    with pytest.raises(ValueError):
        pk.pack(df, "id", capacity=3)


def test_items_that_no_round_can_pack_closer_stay_in_bounded_blocks(spark, monkeypatch):
    """10^5 items of 0.6 of a container: one container each, and no task gets more than its block."""
    from pyspark.sql import functions as F

    rounds, make = [], pk.materialize

    def watched(df, name):
        out = make(df, name)
        if name.startswith("level"):
            rounds.append(out.groupBy("__block").agg(F.sum("tokens").alias("t")).agg(F.max("t"), F.count(F.lit(1))).first())
        return out

    monkeypatch.setattr(pk, "materialize", watched)
    items = spark.range(100_000).select("id", F.repeat(F.lit("x"), 6).alias("text"))
    out = pk.pack(items, "id", capacity=10, block_containers=1000)
    assert out.count() == 100_000 == out.select("container").distinct().count()
    assert 1 <= len(rounds) <= 3 and all(most <= 1.2 * 10 * 1000 and n >= 60 for most, n in rounds)


def test_small_items_fill_up_large_ones_across_blocks(spark):
    from pyspark.sql import functions as F

    items = spark.range(6000).select("id", F.repeat(F.lit("x"), F.when(F.col("id") < 3000, 60).otherwise(40).cast("int")).alias("text"))
    out = pk.pack(items, "id", capacity=100, block_containers=50).groupBy("container").agg(F.sum("tokens").alias("t"))
    r = out.agg(F.count(F.lit(1)), F.max("t"), F.sum("t")).first()
    assert r[1] == 100 and r[2] == 300_000 and r[0] <= 3000 * 1.01
