import hashlib
import uuid
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from mneme.functions import stats, vector as vx
from mneme.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_ids(spark):
    digest = hashlib.sha256(b"/v/a.md::3").hexdigest()
    assert one(spark, tx.point_id(F.col("s"), F.col("n")), s="/v/a.md", n=3) == str(uuid.UUID(digest[:32]))
    assert one(spark, tx.section_id(F.col("s"), F.col("h")), s="a", h="b") == hashlib.sha256(b"a::b").hexdigest()[:16]
    g = hashlib.sha256(b"cache::_global::q").hexdigest()
    assert one(spark, tx.cache_id(F.col("d"), F.col("q")), d=None, q="q") == str(uuid.UUID(g[:32]))


@pytest.mark.parametrize("text, want", [("=== A ===", "~~~ A ==="), ("a---b", "a–––b"), ("x" * 3000, "x" * 2000), (None, None)])
def test_sanitize(spark, text, want):
    assert one(spark, tx.sanitize(F.col("t")), t=text) == want


@pytest.mark.parametrize("path", ["/v/a.md", "a.b.c.md", "/v/.hidden", "/v/ohne", "/v/.x.md", "x"])
def test_stems_are_pathlibs(spark, path):
    assert one(spark, tx.file_stem(F.col("p")), p=path) == PurePosixPath(path).stem and one(spark, tx.file_name(F.col("p")), p=path) == PurePosixPath(path).name


@pytest.mark.parametrize(
    "text, want", [("[[b]] [[a|x]] [[a#y]] [[ c ]]", ["a", "b", "c"]), ("`[[x]]` ```\n[[y]]\n``` [[z]]", ["z"]), ("[[]] [[ ]] [x]", []), ("a ` b\n[[Ziel]]\nc ` d", ["Ziel"]), ("[[#nur]] [[|x]] [[a]b]] [[c|d#e]] `[[f]]`", ["c"]), ("", []), (None, [])]
)
def test_wikilinks(spark, text, want):
    assert one(spark, tx.wikilinks(F.col("t")), t=text) == want


def test_normalize_ages_and_header(spark):
    assert one(spark, tx.normalize_query(F.col("t")), t="  Wie  \n Geht　ES ") == "wie geht es"
    today = F.lit("2025-07-01").cast("date")
    for since, days in [("2025-06-30", 1), ("2025-02-30", None), ("gestern", None), (None, None)]:
        assert one(spark, tx.age_days(F.col("s"), today), s=since) == days
    head = "---\ndomain: haus\nindexed: False\n---\ntext"
    assert one(spark, tx.front_matter_domain(tx.front_matter(F.col("t"))), t=head) == "haus" and one(spark, tx.front_matter_hides(tx.front_matter(F.col("t"))), t=head)
    assert one(spark, tx.front_matter(F.col("t")), t="kein Kopf") == ""


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], {1: 2.0, 2: 1.0}, {2: 3.0, 5: 1.0}, [[1.0, 0.0], [0.0, 2.0]])], "a array<float>, z array<float>, s map<int,float>, t map<int,float>, m array<array<float>>")
    r = df.select(vx.norm(F.col("a")), vx.cosine(F.col("a"), F.col("z")), vx.sparse_dot(F.col("s"), F.col("t")), vx.unit(F.col("z")), vx.max_sim(F.transform("m", vx.unit), F.transform("m", vx.unit)), vx.pool_dense(F.col("m"))).first()
    assert r[0] == 5.0 and r[1] is None and r[2] == 3.0 and r[3] == [0.0, 0.0] and r[4] == 2.0 and abs(r[5][1] / r[5][0] - 2) < 1e-12


def test_percentiles(spark):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("v"))
    r = df.agg(stats.nearest_rank(F.col("v"), 50).alias("a"), stats.nearest_rank(F.col("v"), 95).alias("b"), stats.floor_index(F.collect_list("v"), 0.9).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (5, 10, 9)
    assert df.limit(0).agg(stats.nearest_rank(F.col("v"), 50).alias("a")).first()["a"] is None
    assert spark.range(1).select(stats.rate(F.lit(1), F.lit(0))).first()[0] == 0.0
