import random

import numpy as np

from mneme.llm import leaks as lk


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(3, 9))) for _ in range(n))


def brute(docs, cases, run=50):
    out = set()
    for c, p in cases:
        s = lk.normal(p or "")
        known = {s[i : i + run] for i in range(len(s) - run + 1)}
        for k, t in docs:
            d = lk.normal(t or "")
            if any(d[i : i + run] in known for i in range(len(d) - run + 1)):
                out.add((c, k))
    return out


def test_finds_every_shared_run(spark):
    rng = random.Random(1)
    cases = [(f"g{i}", words(rng, rng.randint(30, 90))) for i in range(60)]
    docs = []
    for i in range(300):
        text = words(rng, rng.randint(5, 400))
        if i % 3 == 0:
            c = cases[rng.randrange(len(cases))][1]
            a = rng.randrange(max(1, len(c) - 100))
            part = c[a : a + rng.choice([45, 58, 62, 75, 90, 400])]
            at = rng.randrange(len(text))
            text = text[:at] + " " + part.upper().replace(" ", "-\n") + " " + text[at:]
        docs.append((i, text))
    d, c = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(cases, "case string, passage string")
    got = {(r["case"], r["key"]) for r in lk.leaks(d, "id", "text", c, "case", "passage").where("verbatim").collect()}
    want = brute(docs, cases)
    assert len(want) > 25 and got == want


def test_paraphrases(spark):
    passage = "Der alte Speicher im Keller verliert nach 14 Tagen ungefähr 230 Einträge und braucht danach einen neuen Filter aus der Werkstatt."
    close = "Der alte Speicher im Keller verliere nach 14 Tagen circa 230 Einträge und brauche danach neuen Filter aus der Werkstatt."
    d = spark.createDataFrame([(1, "Vorweg etwas. " * 20 + close), (2, "Ganz andere Worte stehen hier. " * 30)], "id long, text string")
    out = lk.leaks(d, "id", "text", spark.createDataFrame([("g", passage)], "c string, p string"), "c", "p").collect()
    assert [(r["key"], r["kind"]) for r in out] == [(1, "paraphrase")]


def test_edge_cases(spark):
    p = "abcdefghij" * 6
    docs = [(1, None, "x"), (2, "", "x"), (3, p, "x"), (3, p, "x"), (4, "…—!", "x"), (None, p, "x"), (5, "wort " * 300_000 + p, "x")]
    d = spark.createDataFrame(docs, "id long, text string, figures string")
    cases = spark.createDataFrame([("a", p), ("a", p), ("b", None), ("c", "kurz"), (None, p), ("long", p + "q" * 2000)], "c string, p string")
    got = {(r["case"], r["key"]) for r in lk.leaks(d, "id", "text", cases, "c", "p").where("verbatim").collect()}
    assert got == {("a", 3), ("a", 5), ("long", 3), ("long", 5)}
    assert lk.leaks(d.limit(0), "id", "text", cases, "c", "p").count() == 0 and lk.leaks(d, "id", "text", cases.limit(0), "c", "p").count() == 0


def test_latent_space_keeps_inner_products():
    a = np.random.default_rng(0).standard_normal((40, 500)).astype(np.float32)
    v = lk.randomised_svd(a, 40)
    w = np.random.default_rng(1).standard_normal((7, 500)).astype(np.float32)
    assert np.allclose((w @ v) @ (a @ v).T, w @ a.T, atol=1e-2)


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert lk.common_subsequence(a, b) == slow(a, b)


def test_every_planted_paraphrase_is_found(spark):
    """Every sixth word is replaced, so no run of 50 characters stays; a changed figure makes it another passage."""
    rng = random.Random(11)
    cases, docs, want = [], [], set()
    for i in range(40):
        w = words(rng, 16).split()
        cases.append((f"g{i:02d}", " ".join(w[:8] + [f"{300 + i} Stück"] + w[8:])))
        changed = [words(rng, 1) if k % 5 == 4 else x for k, x in enumerate(w)]
        docs.append((i, words(rng, rng.randint(0, 60)) + " " + " ".join(changed[:8] + [f"{300 + i} Stück"] + changed[8:]) + " " + words(rng, 40)))
        near = lk.normal(" ".join(changed[:8] + [f"{300 + i} Stück"] + changed[8:]))
        passage = lk.normal(cases[-1][1])
        if lk.common_subsequence(passage, near) >= lk.SUBSEQUENCE * len(passage):
            want.add((f"g{i:02d}", i))
        docs.append((100 + i, words(rng, 30) + " " + " ".join(changed[:8] + [f"{900 + i} Stück"] + changed[8:]) + " " + words(rng, 30)))
    docs += [(200 + i, words(rng, 300)) for i in range(100)]
    d, c = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(cases, "c string, p string")
    out = lk.leaks(d, "id", "text", c, "c", "p").collect()
    assert len(want) >= 35 and {(r["case"], r["key"]) for r in out} == want and {r["kind"] for r in out} == {"paraphrase"}
    assert brute(docs, cases) == set()


def test_figures_are_compared_as_numbers():
    assert lk.figures_in("a007b12c3") == {"7", "12", "3"} and lk.figures_in("x000") == {"0"} and lk.figures_in("") == set()


def test_many_groups_of_passages_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    cases = [(f"g{i}", words(rng, rng.randint(20, 60))) for i in range(150)]
    docs = [(i, words(rng, 40) + " " + cases[i % 150][1][rng.randrange(10) :][:90] + " " + words(rng, 40)) for i in range(200)]
    monkeypatch.setattr(lk, "GROUP", 16)
    monkeypatch.setattr(lk, "SENT", 200_000)
    monkeypatch.setattr(lk, "EXACT_TERMS", 10)
    d, c = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(cases, "c string, p string")
    got = {(r["case"], r["key"]) for r in lk.leaks(d, "id", "text", c, "c", "p").where("verbatim").collect()}
    want = brute(docs, cases)
    assert len(want) >= 150 and got == want
