import numpy as np
import pytest
from pyspark.sql import functions as F

from mneme import models
from mneme.operators import answer, cache, compress, index, retrieval as rt

POINT = "point_id string, domain string, source_path string, dense array<float>, sparse map<int,float>, colbert array<array<float>>"
QUERY = "query_id long, sub_idx int, domain string, dense array<float>, sparse map<int,float>, colbert array<array<float>>"


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    points = [
        (f"p{i:03d}", "ab"[i % 2], f"/v/n{i % 20}.md", rng.standard_normal(8).astype(np.float32).tolist(), {int(k): float(w) for k, w in zip(rng.integers(0, 30, 4), rng.random(4))}, rng.standard_normal((1 + i % 4, 4)).astype(np.float32).tolist())
        for i in range(120)
    ]
    points += [("twin1", "a", "/v/t.md", points[0][3], {}, []), ("zero", "a", "/v/z.md", [0.0] * 8, None, None), ("null", "a", "/v/z.md", None, None, None)]
    queries = [(q, s, [None, "a"][s], rng.standard_normal(8).astype(np.float32).tolist(), {int(k): 1.0 for k in rng.integers(0, 30, 6)}, rng.standard_normal((3, 4)).astype(np.float32).tolist()) for q in range(5) for s in range(2)]
    queries.append((9, 0, None, points[0][3], {}, points[0][5]))
    return points, queries


def frames(spark, corpus):
    return spark.createDataFrame(corpus[1], QUERY), spark.createDataFrame(corpus[0], POINT)


def unit(v):
    v = np.array(v, float)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def test_dense_and_ties(spark, corpus):
    q, p = frames(spark, corpus)
    got = {(r["query_id"], r["sub_idx"], r["rank"]): r["point_id"] for r in rt.dense_topn(q, p, 7).collect()}
    for qid, sub, domain, dense, _, _ in corpus[1]:
        order = sorted((-round(float(unit(x[3]) @ unit(dense)), 9), x[0]) for x in corpus[0] if x[3] and any(x[3]) and (domain is None or x[1] == domain))
        assert [got[qid, sub, r] for r in range(1, 8)] == [n for _, n in order[:7]]
    assert got[9, 0, 1] == "p000" and got[9, 0, 2] == "twin1"


def test_sparse_needs_a_shared_token(spark, corpus):
    q, p = frames(spark, corpus)
    out = rt.sparse_topn(q, p, 5).collect()
    assert not [r for r in out if r["query_id"] == 9]
    for qid, sub, domain, _, sparse, _ in corpus[1][:-1]:
        order = sorted((-round(sum(w * x[4][t] for t, w in sparse.items() if t in x[4]), 6), x[0]) for x in corpus[0] if x[4] and set(sparse) & set(x[4]) and (domain is None or x[1] == domain))
        assert [r["point_id"] for r in sorted(out, key=lambda r: r["rank"]) if (r["query_id"], r["sub_idx"]) == (qid, sub)] == [n for _, n in order[:5]]


def test_hybrid_rescores_the_union(spark, corpus):
    q, p = frames(spark, corpus)
    out = rt.hybrid(q, p, 5, prefetch=200).collect()
    for qid, sub, domain, _, _, colbert in corpus[1][:3]:
        sims = sorted((-round(float((unit(colbert) @ unit(x[5]).T).max(1).sum()), 6), x[0]) for x in corpus[0] if x[5] and (domain is None or x[1] == domain))
        assert [r["point_id"] for r in sorted(out, key=lambda r: r["rank"]) if (r["query_id"], r["sub_idx"]) == (qid, sub)] == [n for _, n in sims[:5]]


def test_rrf(spark):
    ranked = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2), (2, 0, "z", 1), (2, 1, "y", 1)], "query_id int, sub_idx int, point_id string, rank int")
    out = {(r["query_id"], r["point_id"]): (r["rank"], r["score"]) for r in rt.rrf(ranked).collect()}
    assert out[1, "b"] == (1, round(1 / 61 + 1 / 62, 6)) and out[2, "y"][0] == 1 and out[2, "z"][0] == 2 and rt.rrf(ranked.limit(0)).count() == 0


def test_search_uses_raw_scores_for_single_queries(spark, corpus):
    q, p = frames(spark, corpus)
    out = rt.search(q, p, top_k=3, most_subs=2).collect()
    assert {r["query_id"] for r in out} == {0, 1, 2, 3, 4, 9} and max(r["score"] for r in out if r["query_id"] == 9) > 0.5 and all(r["score"] < 0.04 for r in out if r["query_id"] < 5)


def test_rerank_pool(spark):
    hits = spark.createDataFrame([(1, i, f"p{i}", 1.0 if i == 3 else 0.0) for i in range(1, 15)], "query_id int, rank int, point_id string, relevance double")
    out = rt.rerank_pool(hits).orderBy("rank").collect()
    assert [r["point_id"] for r in out][:4] == ["p3", "p1", "p2", "p4"] and [r["point_id"] for r in out][10:] == ["p11", "p12", "p13", "p14"]
    assert out[0]["rerank_score"] == 1.0 and out[12]["rerank_score"] is None


def test_related_leaves_out_the_own_note(spark, corpus):
    _, p = frames(spark, corpus)
    anchors = rt.anchor_vectors(p).withColumn("query_id", F.xxhash64("source_path"))
    out = rt.related(anchors, p, 4).join(anchors.select("query_id", F.col("source_path").alias("own")), "query_id").join(p.select("point_id", "source_path"), "point_id")
    assert out.count() == anchors.count() * 4 and out.where("own = source_path").count() == 0


@pytest.mark.parametrize(
    "reply, want", [('["a", " b "]', ["a", "b"]), ('Gerne:\n["a","b"] ok', ["a", "b"]), ('{"queries": ["a"]}', ["a"]), ('{"x": "a", "y": "b"}', ["a", "b"]), ("kein JSON", None), (None, None), ("[]", None)]
)
def test_salvage(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string")
    assert df.select(rt.salvage_list(F.col("r"))).first()[0] == want


def test_decompose_appends_the_question_once(spark):
    df = spark.createDataFrame([("q", ["a", "q"]), ("q", ["a"]), ("q", None)], "question string, subs array<string>")
    assert sorted(r["n"] for r in rt.decompose(df, F.col("subs")).groupBy("subs").agg(F.count("*").alias("n")).collect()) == [1, 2, 2]


def test_cache_stages_ttl_and_counts(spark):
    now = F.lit("2025-07-01").cast("timestamp")
    results = spark.createDataFrame([("Wie geht das", "a", [1.0, 0.0], ["x"]), ("leer", "a", [0.0, 1.0], []), ("global", None, [0.6, 0.8], ["y"])], "sub_query string, domain string, dense array<float>, chunks array<string>")
    entries = cache.make_entries(results, now)
    assert entries.count() == 2
    lookups = spark.createDataFrame(
        [(1, " WIE  geht das ", "a", [0.0, 1.0]), (2, "anders", "a", [0.999, 0.01]), (3, "anders", "b", [1.0, 0.0]), (4, "weit", "a", [0.0, 1.0]), (5, "anders", None, [0.6, 0.8])],
        "lookup_id int, sub_query string, domain string, dense array<float>",
    )
    hits = cache.lookup(lookups, entries, now)
    assert {(r["lookup_id"], r["stage"]) for r in hits.collect()} == {(1, "exact"), (2, "semantic"), (5, "semantic")}
    assert cache.totals(cache.count_hits(entries, hits)).first()["hits"] == 3
    later = F.lit("2025-07-09").cast("timestamp")
    assert cache.lookup(lookups, entries, later).count() == 0 and cache.cleanup(entries, later).count() == 0 and cache.cleanup(entries, later, domain="a").count() == 1
    assert cache.invalidate(entries, "a").count() == 1 and cache.invalidate(entries, "a", with_global=True).count() == 0


def greedy(units, sims, budget):
    head = 1 if units and units[0].startswith("#") else 0
    kept, used = set(range(head)), 0
    for i in sorted(range(head, len(units)), key=lambda i: -sims[i]):
        if len(kept) > head and used + len(units[i]) > budget:
            continue
        kept.add(i)
        used += len(units[i])
    return kept


def test_compression_equals_a_greedy_loop(spark):
    rng = np.random.default_rng(3)
    data = []
    for h in range(30):
        n = int(rng.integers(1, 9))
        data += [(h, i, ("# " if i == 0 and h % 2 else "") + "u" * int(rng.integers(1, 60)), float(rng.integers(0, 4)) / 4) for i in range(n)]
    df = spark.createDataFrame(data, "hit int, idx int, unit string, similarity double")
    kept = compress.select_units(df, ["hit"], 80)
    got, lines = {}, {r["hit"]: r["compact"] for r in compress.join_units(kept, df.groupBy("hit").agg(F.count("*").alias("n")), ["hit"]).collect()}
    for r in kept.collect():
        got.setdefault(r["hit"], set()).add(r["idx"])
    for h in range(30):
        units = [u for hh, _, u, _ in data if hh == h]
        want = greedy(units, [s for hh, _, _, s in data if hh == h], 80)
        assert got[h] == want
        out, last = [], -1
        for i in sorted(want):
            out += ([compress.GAP] if i != last + 1 else []) + [units[i]]
            last = i
        assert lines[h] == "\n".join(out + ([compress.GAP] if last != len(units) - 1 else []))


def test_reorder_prompt_and_answer(spark):
    hits = spark.createDataFrame([(1, r, f"/v/n{r}.md", f"H{r}", f"Text --- {r}") for r in range(1, 6)] + [(2, r, "s", None, "t") for r in (1, 2)], "query_id int, rank int, source string, header string, text string")
    placed = answer.reorder(hits)
    assert [r["rank"] for r in placed.where("query_id = 1").orderBy("position").collect()] == [1, 3, 4, 5, 2] and [r["position"] for r in placed.where("query_id = 2").orderBy("rank").collect()] == [1, 2]
    asked = spark.createDataFrame([(1, "=== Frage"), (2, "b"), (3, "c")], "query_id int, question string")
    made = answer.prompts(placed, asked)
    text = made.where("query_id = 1").first()["prompt"]
    assert "[Abschnitt 1] H1 (Quelle: /v/n1.md)\nText ––– 1" in text and "=== FRAGE ===\n\n~~~ Frage" in text and text.endswith("=== ANTWORT ===")
    out = {r["query_id"]: r["answer"] for r in answer.ask(made, asked, models.echo_generator).collect()}
    assert out[3] == answer.NOTHING and out[1].startswith(str(len(text)))


def test_points_are_checked_and_replaced(spark, rows):
    chunk = "text string, source string, chunk_id int, header string, dense array<float>, sparse map<int,float>, colbert array<array<float>>"
    build = lambda data: index.build_points(spark.createDataFrame(data, chunk), F.lit("/v/a.md"), F.lit("a"), F.lit("r1"), F.lit("h"))
    good = build([("t", "a.md", 0, "H", [1.0], {1: 1.0}, [[1.0]] * 1000)])
    assert good.count() == 1
    for bad in ([("t", "a.md", 0, "H", [1.0], None, [[1.0]] * 1001)], [("t", "a.md", 0, "H", None, None, None)]):
        with pytest.raises(Exception, match="chunk (too large|without vectors)"):
            build(bad).collect()
    old = spark.createDataFrame([("p1", "/a", "r1"), ("p2", "/a", None), ("p3", "/b", "r1")], "point_id string, source_path string, run_id string")
    new = spark.createDataFrame([("p1", "/a", "r2"), ("p4", "/a", "r2")], old.schema)
    merged = index.upsert(old, new)
    assert rows(index.delete_stale(merged, new.select("source_path", "run_id").distinct()), "point_id", "source_path", "run_id") == [("p1", "/a", "r2"), ("p3", "/b", "r1"), ("p4", "/a", "r2")]


def test_encoder_is_deterministic_and_of_unit_length(spark):
    df = models.encode(spark.createDataFrame([("ein Text",), ("ein Text",), ("",), (None,)], "t string"), "t", models.HashingEncoder(16))
    v = [r["dense"] for r in df.collect()]
    assert v[0] == v[1] and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not any(v[2]) and not any(v[3])


def test_every_sub_query_is_reranked(spark):
    from mneme.plans import registry

    data = "/root/testdata/sf0.01"
    out = registry.queries()["rerank_pools"](spark, data)
    assert out.select("query_id", "sub_idx").distinct().count() == spark.read.parquet(f"{data}/query_vecs.parquet").select("query_id").distinct().count() == 10


def test_index_with_all_probes_is_exact_and_with_few_is_near(spark):
    import numpy as np

    from mneme.operators.vector_index import VectorIndex, learn_centroids

    rng = np.random.default_rng(5)
    middle = rng.standard_normal((12, 8))
    x = middle[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 8))
    rows = [(f"p{i:03d}", ["a", "b", None][i % 3], v.tolist()) for i, v in enumerate(x)] + [("none", "a", None), ("zero", "a", [0.0] * 8)]
    points = spark.createDataFrame(rows, "point_id string, domain string, dense array<float>")
    asked = spark.createDataFrame([(i, 0, [None, "a"][i % 2], (middle[i % 12] + 0.2 * rng.standard_normal(8)).tolist()) for i in range(30)] + [(99, 0, None, None)], "query_id long, sub_idx int, domain string, dense array<float>")
    held = VectorIndex(points)
    want = {(r["query_id"], r["point_id"], r["rank"]) for r in rt.dense_topn(asked, points, 5).collect()}
    assert {(r["query_id"], r["point_id"], r["rank"]) for r in held.search(asked, 5, len(held.centroids)).collect()} == want and len(want) == 150
    some = {(r["query_id"], r["point_id"]) for r in held.search(asked, 5, max(1, len(held.centroids) // 4)).collect()}
    assert len(some & {w[:2] for w in want}) >= 0.9 * len(want)
    assert VectorIndex(points.limit(0)).search(asked, 5, 3).count() == 0
    assert np.allclose(np.linalg.norm(learn_centroids(x / np.linalg.norm(x, axis=1, keepdims=True), 20), axis=1), 1)


def test_queries_in_several_blocks_are_those_of_one(spark, monkeypatch):
    points = spark.range(200).select(F.concat(F.lit("p"), F.col("id")).alias("point_id"), F.lit("a").alias("domain"), F.array(F.sin("id").cast("float"), F.cos(F.col("id") * 3).cast("float"), F.lit(0.2).cast("float")).alias("dense"))
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.lit(0).alias("sub_idx"), F.lit(None).cast("string").alias("domain"), F.array(F.cos("id").cast("float"), F.sin("id").cast("float"), F.lit(0.1).cast("float")).alias("dense"))
    whole = {tuple(r) for r in rt.dense_topn(asked, points, 3).collect()}
    monkeypatch.setattr(rt, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in rt.dense_topn(asked, points, 3).collect()} == whole and len(whole) == 120
