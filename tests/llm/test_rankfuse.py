import math
import random

from mneme.llm import rankfuse as rf


def beta_cdf(x, k, m):
    return sum(math.comb(m, j) * x**j * (1 - x) ** (m - j) for j in range(k, m + 1))


def brute(items):
    """items: key -> scores (None below all others)."""
    m, n = 3, len(items)
    out = {}
    for key, scores in items.items():
        r = []
        for i in range(m):
            if scores[i] is None:
                r.append(1.0)
            else:
                r.append(sum(o[i] is not None and o[i] >= scores[i] for o in items.values()) / n)
        ordered = sorted(r)
        out[key] = min(1.0, m * min(beta_cdf(ordered[k - 1], k, m) for k in range(1, m + 1)))
    return out


def test_equals_brute_force_with_ties_and_nulls(spark):
    random.seed(3)
    data = []
    for q in range(4):
        for i in range(40 if q else 1):
            s = [random.choice([None, round(random.gauss(0, 1), 1) * scale]) if random.random() < 0.2 else random.gauss(0, 1) * scale for scale in (1, 1000, 0.001)]
            data.append((q, f"p{i}", *map(lambda v: v, s), 1))
    df = spark.createDataFrame(data, "q long, p string, a double, b double, c double, extra int")
    got = {(r["q"], r["p"]): r["rho"] for r in rf.aggregate_ranks(df, "q", "p", ["a", "b", "c"]).collect()}
    for q in range(4):
        want = brute({p: (a, b, c) for qq, p, a, b, c, _ in data if qq == q})
        for p, rho in want.items():
            assert math.isclose(got[q, p], rho, abs_tol=1e-12)


def test_scale_does_not_matter_and_all_lists_count(spark):
    data = [(1, f"x{i}", i / 100, 1000.0 * (i % 37), 1e-6 * (i % 41)) for i in range(100)]
    data += [(1, f"good{i}", 0.985 - i / 1000, 35_900.0 - i, 39.4e-6) for i in range(3)] + [(1, "onelist", 5.0, -1.0, -1.0)]
    df = spark.createDataFrame(data, "q int, p string, a double, b double, c double")
    top = rf.best(rf.aggregate_ranks(df, "q", "p", ["a", "b", "c"]), "q", "p", 3).collect()
    assert {r["p"] for r in top} == {"good0", "good1", "good2"}


def test_repeats_nulls_nan_and_empty(spark):
    data = [(1, "a", 0.5, 1.0, 1), (1, "a", 0.9, 1.0, 2), (1, "b", float("nan"), None, 1), (1, None, 1.0, 1.0, 1), (None, "c", 1.0, 1.0, 1)]
    df = spark.createDataFrame(data, "q int, p string, s double, t double, at int")
    out = {r["p"]: r for r in rf.aggregate_ranks(df, "q", "p", ["s", "t"], "at").collect()}
    assert set(out) == {"a", "b"} and out["a"]["r_s"] == 0.5 and out["b"]["r_s"] == 1.0 and out["b"]["rho"] == 1.0
    assert rf.aggregate_ranks(df.limit(0), "q", "p", ["s", "t"], "at").count() == 0


def test_a_group_is_ranked_in_blocks(spark):
    """One group over several partitions gets the ranks of a global sort."""
    from pyspark.sql import functions as F

    from mneme.operators.ranking import group_rank

    df = spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") % 1000).cast("double").alias("v"))
    got = {r["v"]: r["rank"] for r in group_rank(df, ["g"], "v").collect()}
    assert got == {float(v): 5 * (1000 - v) for v in range(1000)}
