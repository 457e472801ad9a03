import random

from mneme.llm import neardup as nd


def texts(n, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    out = []
    for i in range(n):
        base = [rng.choice(vocab) for _ in range(rng.randint(25, 80))]
        out.append(base)
        if i % 3 == 0:
            edited = list(base)
            for _ in range(rng.randint(1, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            out.append(edited)
        if i % 7 == 0:
            half = len(base) // 2
            out.append(base[half:] + base[:half])
    return [" ".join(x) for x in out]


def brute(data, least, least_words, run):
    sets = {}
    for k, o, t in data:
        w = nd.words(t or "")
        if k is not None and len(w) >= max(least_words, run):
            sets[k] = (o, {tuple(w[i : i + run]) for i in range(len(w) - run + 1)})
    keys, out = sorted(sets), set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a][1], sets[b][1]
            if sets[a][0] != sets[b][0] and len(x & y) >= least * len(x | y):
                out.add((a, b))
    return out


def test_pairs_equal_brute_force(spark):
    data = [(f"p{i:04d}", f"n{i % 97}", t) for i, t in enumerate(texts(250))]
    data += [("dup1", "other", data[0][2]), ("dup2", "other2", data[0][2].upper())]
    df = spark.createDataFrame(data, "key string, owner string, text string")
    got = {(r["a"], r["b"]) for r in nd.pairs_of(*nd.near_duplicates(df, "key", "owner", "text", 0.5, 20, 3)).collect()}
    want = brute(data, 0.5, 20, 3)
    assert len(want) > 50 and got <= want and len(got) / len(want) >= 0.98


def test_groups_are_connected_components(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    chain = []
    for i in range(12):  # each near the next, the ends far apart
        chain.append(" ".join(base))
        for j in range(2 * i, 2 * i + 2):
            base[(j * 5) % 60] = f"u{rng.randrange(10**6)}"
    data = [(f"c{i:02d}", f"n{i}", t) for i, t in enumerate(chain)] + [("lonely", "x", " ".join(f"z{i}" for i in range(40))), ("copy", "y", chain[3])]
    df = spark.createDataFrame(data, "id string, note string, body string")
    members, links = nd.near_duplicates(df, "id", "note", "body", 0.5, 20, 3)
    out = {r["key"]: (r["group"], r["n_links"]) for r in nd.groups_of(members, links).collect()}
    edges, parent = brute(data, 0.5, 20, 3), {k: k for k, _, _ in data}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[root(a)] = root(b)
    for a in out:
        for b in out:
            assert (out[a][0] == out[b][0]) == (root(a) == root(b))
    assert out["lonely"][1] == 0 and out["copy"][0] == out["c03"][0]


def test_many_copies_are_linked_without_all_pairs(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(f"k{i:04d}", f"n{i % 5}", text) for i in range(400)]
    df = spark.createDataFrame(data, "key string, owner string, text string")
    pairs = nd.pairs_of(*nd.near_duplicates(df, "key", "owner", "text", 0.5, 20, 3)).collect()
    seen = {x for r in pairs for x in (r["a"], r["b"])}
    assert len(seen) == 400 and len(pairs) < 400 * 64 and all(r["a"] < r["b"] for r in pairs)


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    data = [("a", "n1", text, 1), ("a", "n1", text, 2), ("b", "n1", text, 1), ("c", None, text, 1), ("s", "n2", "zu kurz", 1), ("e", "n3", "", 1), ("n", "n4", None, 1), (None, "n5", text, 1), ("long", "n6", text + " " + "wort " * 200_000, 1)]
    df = spark.createDataFrame(data, "key string, owner string, text string, cls int")
    pairs = {(r["a"], r["b"]) for r in nd.pairs_of(*nd.near_duplicates(df, "key", "owner", "text", 0.5, 20, 3)).collect()}
    assert {("a", "c"), ("b", "c")} <= pairs and ("a", "b") not in pairs and not {x for p in pairs for x in p} & {"s", "e", "n"}
    members, links = nd.near_duplicates(df.limit(0), "key", "owner", "text")
    assert nd.pairs_of(members, links).count() == 0 and nd.groups_of(members, links).count() == 0


def test_signature_agreement_estimates_similarity():
    import numpy as np

    every = np.random.default_rng(2).integers(0, 1 << 63, 450, dtype=np.uint64)
    a, b = every[:300], every[150:]
    keys = nd.signature([np.sort(a), np.sort(b)], 4000)
    share = (keys[0] == keys[1]).mean()
    assert abs(share - (1 / 3) ** 4) < 0.006


def test_a_class_of_many_copies_keeps_all_its_pairs(spark):
    """70 copies in one note, one more in another, and edited variants of both notes."""
    base = [f"w{i}" for i in range(40)]
    data = [(f"k{i:03d}", "p", " ".join(base)) for i in range(70)] + [("z", "q", " ".join(base))]
    data += [("variant", "p", " ".join(base[:-1] + ["x"])), ("a", "r", " ".join(["y"] + base[1:]))]
    df = spark.createDataFrame(data, "key string, owner string, text string")
    members, links = nd.near_duplicates(df, "key", "owner", "text", 0.5, 20, 3)
    want, block = brute(data, 0.5, 20, 3), nd.BLOCK
    for nd.BLOCK in (7, block):
        rows = [(r["a"], r["b"]) for r in nd.every_pair(members, links).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    linked = {(r["a"], r["b"]) for r in nd.pairs_of(members, links).collect()}
    assert linked <= want and ("variant", "z") in linked and {("a", f"k{i:03d}") for i in range(70)} <= linked


def test_registered_query_lists_every_pair(spark, tmp_path):
    from mneme.llm.queries import QUERIES

    base = [f"w{i}" for i in range(40)]
    data = [(f"k{i:03d}", "p", " ".join(base)) for i in range(70)] + [("z", "q", " ".join(base)), ("variant", "p", " ".join(base[:-1] + ["x"])), ("other", "r", " ".join(["y"] + base[1:]))]
    spark.createDataFrame(data, "point_id string, source_path string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    assert {tuple(r) for r in QUERIES["p6_found"](spark, str(tmp_path)).collect()} == brute(data, 0.5, 20, 3)


def test_a_band_that_many_different_texts_share_is_paired_in_blocks(spark):
    """90 variants of one text: every band is hot at a block of 16."""
    base = [f"w{i}" for i in range(60)]
    data = [(f"k{i:02d}", f"n{i % 9}", " ".join(base[:-1] + [f"x{i}"])) for i in range(90)]
    df = spark.createDataFrame(data, "key string, owner string, text string")
    block = nd.BLOCK
    try:
        nd.BLOCK = 16
        rows = [(r["a"], r["b"]) for r in nd.every_pair(*nd.near_duplicates(df, "key", "owner", "text", 0.5, 20, 3)).collect()]
    finally:
        nd.BLOCK = block
    assert len(rows) == len(set(rows)) and set(rows) == brute(data, 0.5, 20, 3)


def test_copies_of_two_linked_classes_keep_a_pair_of_every_two_notes(spark):
    """64 copies in note x and one in another note, in either of two linked classes."""
    base = [f"w{i}" for i in range(40)]
    other = " ".join(base[:-1] + ["v"])
    data = [(f"a{i:02d}", "x", " ".join(base)) for i in range(64)] + [("ay", "y", " ".join(base))] + [(f"b{i:02d}", "x", other) for i in range(64)] + [("bz", "z", other)]
    df = spark.createDataFrame(data, "key string, owner string, text string")
    members, links = nd.near_duplicates(df, "key", "owner", "text", 0.5, 20, 3)
    owner = {k: o for k, o, _ in data}
    crossing = {(owner[r["a"]], owner[r["b"]]) for r in nd.pairs_of(members, links).collect() if r["a"][0] != r["b"][0]}
    assert crossing == {("x", "z"), ("y", "x"), ("y", "z")}
    assert {(r["a"], r["b"]) for r in nd.every_pair(members, links).collect()} == brute(data, 0.5, 20, 3)


def test_a_key_repeated_with_another_text_counts_once(spark):
    base = [f"w{i}" for i in range(40)]
    data = [("a", "p", " ".join(base)), ("a", "p", " ".join(f"z{i}" for i in range(40))), ("b", "q", " ".join(base[:-1] + ["x"])), ("c", "r", " ".join([f"z{i}" for i in range(39)] + ["x"]))]
    df = spark.createDataFrame(data, "key string, owner string, text string")
    pairs = {(r["a"], r["b"]) for r in nd.every_pair(*nd.near_duplicates(df, "key", "owner", "text", 0.5, 20, 3)).collect()}
    assert len(pairs) == 1 and pairs <= {("a", "b"), ("a", "c")}
