import numpy as np

from mneme.llm import neighbours as nb


def clustered(n, pairs, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(pairs):
        x[2 * i + 1] = x[2 * i] + rng.standard_normal(dim) * 0.12
    return x


def brute(names, owners, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(x)):
        near = sorted((-s[i, j], names[j]) for j in range(len(x)) if owners[i] != owners[j] and s[i, j] >= least)
        out |= {(names[i], name) for _, name in near[:k]}
    return out


def test_recall_against_brute_force(spark):
    x = clustered(1200, 300).astype(np.float32).astype(np.float64)
    names, owners = [f"p{i:04d}" for i in range(len(x))], [f"n{i % 400}" for i in range(len(x))]
    df = spark.createDataFrame([(a, o, v.tolist()) for a, o, v in zip(names, owners, x)], "id string, note string, dense array<float>")
    got = {(r["id"], r["neighbour"]) for r in nb.nearest(df, "id", "note", "dense", 5, 0.9).collect()}
    want = brute(names, owners, x, 5, 0.9)
    assert len(want) > 400 and len(got & want) / len(want) >= 0.99 and not got - want


def test_equal_vectors_are_one_class(spark):
    """A vector that most rows share: every row still has its five smallest neighbours of other notes."""
    data = [(f"a{i:03d}", f"n{i % 3}", [1.0, 2.0, 3.0]) for i in range(300)] + [("b", "m", [1.0, 2.0, 3.001])]
    df = spark.createDataFrame(data, "id string, note string, dense array<float>")
    out = nb.nearest(df, "id", "note", "dense", 5, 0.9).collect()
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append((r["position"], r["neighbour"]))
    assert len(by) == 301
    for i in (0, 1, 299):
        want = [f"a{j:03d}" for j in range(300) if j % 3 != i % 3][:5]
        assert [n for _, n in sorted(by[f"a{i:03d}"])] == want
    assert [n for _, n in sorted(by["b"])] == [f"a{j:03d}" for j in range(5)]


def test_edge_cases(spark):
    data = [
        ("a", "n1", [1.0, 0.0], 1), ("a", "n1", [1.0, 0.0], 2), ("b", "n2", [0.99, 0.01], 1), ("zero", "n3", [0.0, 0.0], 1), ("null", "n4", None, 1), ("empty", "n5", [], 1),
        ("nan", "n6", [float("nan"), 1.0], 1), ("odd", "n7", [1.0, 0.0, 0.0], 1), (None, "n8", [1.0, 0.0], 1), ("c", None, [1.0, 0.001], 1), ("inf", "n9", [float("inf"), 1.0], 1),
    ]
    df = spark.createDataFrame(data, "id string, note string, dense array<float>, cls int")
    got = {(r["id"], r["neighbour"]) for r in nb.nearest(df, "id", "note", "dense", 5, 0.9).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc" if x != y}
    assert nb.nearest(df.limit(0), "id", "note", "dense", 5, 0.9).count() == 0
    one = spark.createDataFrame(data[:1], df.schema)
    assert nb.nearest(one, "id", "note", "dense", 5, 0.9).count() == 0


def test_exact_search_in_blocks(spark):
    from pyspark.sql import functions as F

    x = clustered(300, 50)
    df = spark.createDataFrame([(f"p{i:03d}", f"n{i % 50}", v.tolist()) for i, v in enumerate(x)], "id string, note string, dense array<double>")
    out = nb.exact(df, F.col("id") < "p040", "id", "note", "dense", 3).collect()
    assert len(out) == 120
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for r in out:
        i = int(r["id"][1:])
        best = sorted((-s[i, j], j) for j in range(300) if j % 50 != i % 50)[: r["position"]][-1]
        assert r["neighbour"] == f"p{best[1]:03d}"


def test_rotations_are_orthogonal_and_codes_deterministic():
    x = clustered(500, 100, dim=16)
    r = nb.learn_rotation(x, np.random.default_rng(1))
    assert np.allclose(r.T @ r, np.eye(16), atol=1e-8)
    big = np.hstack([nb.learn_rotation(x, np.random.default_rng(s)) for s in range(6)])
    keys, sig = nb.encode(x, big, 4, 14)
    again, _ = nb.encode(x[:7], big, 4, 14)
    assert (keys[:7] == again).all() and len(np.unique(keys >> 40)) == 4 and sig.dtype == np.int64


def test_crowded_buckets_are_scanned_exactly(spark):
    """A third of all vectors in one tight cluster, all of them different."""
    rng = np.random.default_rng(9)
    x = np.vstack([np.ones(16) + rng.standard_normal((400, 16)) * 0.02, clustered(800, 200, dim=16, seed=8)])
    names, owners = [f"p{i:04d}" for i in range(len(x))], [f"n{i % 300}" for i in range(len(x))]
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(a, o, v.tolist()) for a, o, v in zip(names, owners, x)], "id string, note string, dense array<float>")
    got = {(r["id"], r["neighbour"]) for r in nb.nearest(df, "id", "note", "dense", 5, 0.9, most=100).collect()}
    want = brute(names, owners, x, 5, 0.9)
    assert len(got & want) / len(want) >= 0.99 and {p for p in got if p[0] < "p0400"} == {p for p in want if p[0] < "p0400"}


def test_every_point_gets_its_nearest_however_far(spark):
    """All points ask, most of them without a near one; copies of a vector, a note with a third of the points, two blocks."""
    from pyspark.sql import functions as F

    x = clustered(900, 100, dim=24, seed=3).astype(np.float32).astype(np.float64)
    x[600:640] = x[0]
    names, owners = [f"p{(i * 389) % 900:04d}" for i in range(900)], ["hot" if i % 3 == 0 else f"n{i % 200}" for i in range(900)]
    df = spark.createDataFrame([(a, o, v.tolist()) for a, o, v in zip(names, owners, x)], "id string, note string, dense array<float>").repartition(3)
    block, nb.QUERY_BLOCK = nb.QUERY_BLOCK, 500
    try:
        out = nb.exact(df, F.lit(True), "id", "note", "dense", 5).collect()
    finally:
        nb.QUERY_BLOCK = block
    got = {}
    for r in out:
        got.setdefault(r["id"], []).append((r["position"], r["neighbour"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(900):
        s = np.round((unit * unit[i]).sum(1), 12)
        want = [name for _, name in sorted((-s[j], names[j]) for j in range(900) if owners[i] != owners[j])[:5]]
        assert [name for _, name in sorted(got[names[i]])] == want


def test_registered_query_gives_five_for_every_point(spark):
    from mneme.llm.queries import QUERIES
    from tests.conftest import DATA

    counts = QUERIES["p3_nearest"](spark, DATA).groupBy("point_id").count().collect()
    points = spark.read.parquet(f"{DATA}/chunks.parquet").where("exists(dense, x -> x <> 0)").select("point_id").distinct().count()
    assert len(counts) == points and {r["count"] for r in counts} == {5}


def test_recall_at_the_least_cosine_holds_at_every_size():
    """By the formula, and with the substrings of 12 million vectors and more on pairs at the threshold that the rotations have not seen."""
    for size in (1_000, 150_000, 1_500_000, 12_000_000, 300_000_000):
        bits = nb.bits_for(size)
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - agree) ** nb.tables_for(bits, 0.9) >= 0.99
    rng = np.random.default_rng(4)
    sample, x, away = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((n, 64)) for n in (8192, 1000, 1000)))
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.9**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    tables = nb.tables_for(24, 0.9)
    turns = np.hstack([nb.learn_rotation(sample, np.random.default_rng(seed)) for seed in range(-(-tables * 24 // 64))])
    met = nb.encode(x, turns, tables, 24)[0] == nb.encode(y, turns, tables, 24)[0]
    assert met.any(1).mean() >= 0.97 and met[:, :64].any(1).mean() < 0.85
