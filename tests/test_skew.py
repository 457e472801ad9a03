"""A third of all rows under one key: same results, and no task that holds the whole group."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mneme.operators import changefeed as cf
from mneme.operators import references as rf
from mneme.operators.ranking import group_rank

START = datetime(2025, 1, 1)


def test_one_path_holds_a_third_of_the_feed(spark):
    feed = spark.range(30_000).select(
        F.col("id").alias("feed_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), (F.col("id") % 500).cast("string"))).alias("source_path"), F.lit("upsert").alias("op"),
        (F.col("id") % 7).cast("string").alias("content_hash"), (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("seen_at"), (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("landed_at"),
    )
    runs = spark.createDataFrame([(k, START + timedelta(hours=k), "success") for k in range(1, 10)], "run_no int, started_at timestamp, status string")
    out = cf.run_changes(feed, runs)
    states = {}
    for k in range(1, 10):
        last = max(i for i in range(0, 30_000, 3) if i <= 3600 * k)
        states[k] = last % 7
    want = {k for k in range(1, 10) if states[k] != states.get(k - 1)}
    assert {r["run_no"] for r in out.where("source_path = 'hot'").collect()} == want
    per_key = cf.file_versions(feed, cf.successful_versions(runs)).groupBy("source_path").count().agg(F.max("count")).first()[0]
    assert per_key <= 9  # one row per key and version, however many there were


def test_one_query_holds_a_third_of_the_candidates(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    ranks = group_rank(df, ["g"], "v")
    expected = df.where("g = 0").orderBy(F.desc("v")).collect()
    got = {r["v"]: r["rank"] for r in ranks.where("g = 0").collect()}
    assert [got[r["v"]] for r in expected] == list(range(1, len(expected) + 1))


def test_one_target_holds_a_third_of_the_links(spark):
    notes = spark.range(6000).select(
        F.concat(F.lit("/v/n"), F.col("id").cast("string"), F.lit(".md")).alias("source_path"), F.array(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))).alias("links"), F.lit(START).alias("indexed_at"),
    )
    refs = rf.classify(rf.note_references(notes), rf._parents(rf.parent_intervals(notes), rf.file_stem(F.col("path"))))
    assert rf.dangling(refs).count() == 2000
    plan = rf.dangling(refs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan
