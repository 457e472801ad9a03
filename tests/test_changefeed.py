import random
from datetime import datetime, timedelta

import pytest

from mneme.operators import changefeed as cf

START = datetime(2025, 1, 1)
FEED = "feed_id long, source_path string, op string, content_hash string, updated string, seen_at timestamp, landed_at timestamp, version int"
RUNS = "run_no int, started_at timestamp, status string"


def brute(feed, runs):
    out, before = set(), {}
    for no, at, status in sorted(runs, key=lambda r: (r[1], r[0])):
        if status != "success":
            continue
        newest = {}
        for fid, path, op, hash_, _, seen, landed, _ in feed:
            if path is None or seen is None or landed is None or landed > at or (op == "upsert" and hash_ is None):
                continue
            if path not in newest or (seen, fid) > newest[path][0]:
                newest[path] = ((seen, fid), op, hash_)
        now = {p: h.lower() for p, (_, op, h) in newest.items() if op != "delete"}
        out |= {(no, p) for p, h in now.items() if before.get(p) != h}
        before = now
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    feed = []
    for i in range(400):
        seen = START + timedelta(minutes=rng.randrange(5000))
        feed.append((i, rng.choice(["hot", *(f"n{k}" for k in range(20)), None]), rng.choice(["upsert"] * 5 + ["delete"]), rng.choice(["aa", "AA", "bb", "cc", None]), None, seen, seen + timedelta(minutes=rng.choice([0, 1, 900])), 0))
    feed += feed[:40]
    runs = [(k, START + timedelta(minutes=500 * k), rng.choice(["success", "success", "failed", "running"])) for k in range(1, 11)]
    got = rows(cf.run_changes(spark.createDataFrame(feed, FEED), spark.createDataFrame(runs, RUNS)), "run_no", "source_path")
    assert set(got) == brute(feed, runs) and len(got) == len(set(got))


def test_empty_tables_and_no_success(spark):
    feed, runs = spark.createDataFrame([], FEED), spark.createDataFrame([(1, START, "failed")], RUNS)
    assert cf.run_changes(feed, runs).count() == 0
    one = spark.createDataFrame([(1, "a", "upsert", "h", None, START, START, 0)], FEED)
    assert cf.run_changes(one, runs).count() == 0 and cf.run_changes(one, runs.limit(0)).count() == 0
    assert cf.run_changes(one, spark.createDataFrame([(1, START, "success"), (2, START, "success")], RUNS)).count() == 1


def table(spark, path):
    return cf.ManifestTable(spark, str(path), "id")


def test_manifest_table_versions_and_diff(spark, rows, tmp_path):
    t = table(spark, tmp_path / "t")
    df = lambda data: spark.createDataFrame(data, "id string, v int")
    assert t.latest() == 0 and t.read() is None
    t.commit(df([("a", 1), ("b", 1)]))
    t.commit(df([("b", 2), ("c", 1)]))
    t.commit(None, df([("a", 0)]))
    assert rows(t.read()) == [("b", 2), ("c", 1)] and rows(t.read(1)) == [("a", 1), ("b", 1)]
    added, removed = t.diff(1, 3)
    assert rows(added) == [("b", 2), ("c", 1)] and rows(removed) == [("a", 1), ("b", 1)]
    assert t.diff(3, 3) == (None, None)


def test_runs_survive_failures_without_skipping_or_repeating(spark, rows, tmp_path):
    source, target = table(spark, tmp_path / "s"), table(spark, tmp_path / "t")
    df = lambda data: spark.createDataFrame(data, "id string, v int")
    seen = []

    def step(batch):
        seen.append(sorted(r["id"] for r in batch.collect()))
        return batch.selectExpr("id", "v * 10 as v")

    def failing(batch):
        raise RuntimeError("lost")

    source.commit(df([("a", 1), ("b", 1)]))
    assert cf.process_new(source, target, step) == 1 and cf.process_new(source, target, step) is None
    source.commit(df([("b", 2), ("c", 3)]))
    with pytest.raises(RuntimeError):
        cf.process_new(source, target, failing)
    source.commit(df([("d", 4)]), df([("a", 0)]))
    cf.process_new(source, target, step)
    assert seen == [["a", "b"], ["b", "c", "d"]] and rows(target.read()) == [("b", 20), ("c", 30), ("d", 40)]
    # a writer that was overtaken must not win
    stale = target.manifest(target.latest())
    with pytest.raises(FileExistsError):
        target._files.write_once(f"_manifests/{stale['version']:06d}.json", "{}")


def test_unchanged_rows_are_left_alone_on_demand(spark, tmp_path):
    from pyspark.sql import functions as F

    source, target = table(spark, tmp_path / "s"), table(spark, tmp_path / "t")
    df = lambda data: spark.createDataFrame(data, "id string, v int")
    seen = []
    step = lambda b: (seen.append(sorted(r["id"] for r in b.collect())), b)[1]
    source.commit(df([("a", 1), ("b", 1)]))
    cf.process_new(source, target, step, same=F.col("v"))
    source.commit(df([("a", 1), ("b", 2)]))
    cf.process_new(source, target, step, same=F.col("v"))
    assert seen == [["a", "b"], ["b"]]


def test_steps_compaction_and_vacuum(spark, rows, tmp_path):
    t = table(spark, tmp_path / "t")
    df = lambda data: spark.createDataFrame(data, "id string, v int")
    t.commit(df([("a", 1), ("b", 1)]))
    t.commit(df([("b", 2)]), df([("a", 0)]), note="x")
    assert t.compact() == 3 and rows(t.read()) == [("b", 2)] and t.manifest(3)["tags"] == {"note": "x"} and t.diff(2, 3) == (None, None)
    t.append(spark.createDataFrame([("c", 3, "neu")], "id string, v int, w string"))
    t.commit(None, df([("b", 0), ("fehlt", 0)]))
    assert rows(t.read()) == [("c", 3, "neu")] and rows(t.read(2)) == [("b", 2)]
    steps = t.steps(0, 5)
    assert rows(steps, "version", "change", "id", "v") == [(1, "+", "a", 1), (1, "+", "b", 1), (2, "+", "b", 2), (2, "-", "a", 1), (2, "-", "b", 1), (4, "+", "c", 3), (5, "-", "b", 2)]
    added, removed = t.diff(1, 5)
    assert rows(added, "id") == [("c",)] and rows(removed, "id", "v") == [("a", 1), ("b", 1)]
    assert len(t.vacuum()) > 0 and rows(t.read(), "id") == [("c",)]


def test_a_lost_race_is_made_again_on_top(spark, rows, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    df = lambda data: spark.createDataFrame(data, "id string, v int")
    t.commit(df([("a", 1)]))
    publish, raced = t._publish, []

    def late(*args, **kw):
        if not raced:
            raced.append(other.commit(df([("b", 1), ("a", 2)])))
        return publish(*args, **kw)

    monkeypatch.setattr(t, "_publish", late)
    assert t.commit(df([("a", 3)])) == 3 and rows(t.read()) == [("a", 3), ("b", 1)]
    raced.clear()
    with pytest.raises(FileExistsError):
        t.commit(df([("a", 4)]), expect=3)
    assert rows(t.read()) == [("a", 2), ("b", 1)]


def test_a_crash_between_write_and_commit_neither_skips_nor_repeats(spark, rows, tmp_path, monkeypatch):
    """The output is written, the commit never happens; the next run does the same records once."""
    rng = random.Random(9)
    feed = [(i, f"n{rng.randrange(12)}", rng.choice(["upsert", "upsert", "delete"]), rng.choice(["aa", "bb"]), None, START + timedelta(minutes=i), START + timedelta(minutes=i), 0) for i in range(200)]
    runs = [(k, START + timedelta(minutes=40 * k), "success") for k in range(1, 5)]
    source, target = cf.ManifestTable(spark, str(tmp_path / "s"), "source_path"), cf.ManifestTable(spark, str(tmp_path / "t"), ["version", "source_path"])
    cf.replay(spark.createDataFrame(feed, FEED), cf.successful_versions(spark.createDataFrame(runs, RUNS)), source)
    publish = target._publish
    monkeypatch.setattr(target, "_publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        cf.process_steps(source, target, cf.changed_states)
    assert target.read() is None and list((tmp_path / "t").iterdir())
    monkeypatch.setattr(target, "_publish", publish)
    assert cf.process_steps(source, target, cf.changed_states) == 1 and cf.process_steps(source, target, cf.changed_states) is None
    assert set(rows(target.read(), "version", "source_path")) == brute(feed, runs)
