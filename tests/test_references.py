from datetime import datetime

from mneme.operators import references as rf

T = lambda m, d=1: datetime(2025, m, d)
NOTES = "source_path string, links array<string>, indexed_at timestamp, path string, key string"


def vault(spark):
    notes = spark.createDataFrame(
        [
            ("/v/a.md", ["b#x", " c ", "b|y", "weg", "nie", "", None, "#nur", "Weg", "x.y"], T(1), "extra", "k"), ("/v/a.md", ["b#x"], T(1), "extra", "k"),
            ("/v/b.md", None, T(1), "extra", "k"), ("/v/c.md", [], T(5), "extra", "k"), ("/w/x.y.md", ["a"], T(2), "extra", "k"), (None, ["z"], T(2), "extra", "k"),
        ],
        NOTES,
    )
    chunks = spark.createDataFrame(
        [("p1", "/v/a.md", T(2)), ("p1", "/v/a.md", T(3)), ("p2", "/v/weg.md", T(2)), ("p3", "/v/nie.md", T(4)), ("p4", None, T(4)), ("p5", "/v/c.md", T(4)), ("p6", "/v/b.md", None)],
        "point_id string, source_path string, ingested_at timestamp",
    )
    feed = spark.createDataFrame([("/v/weg.md", "upsert", T(1)), ("/v/weg.md", "delete", T(3)), ("/v/b.md", "delete", T(1)), ("/v/only.md", "delete", T(1))], "source_path string, op string, seen_at timestamp")
    return notes, chunks, feed


def test_status_of_every_reference(spark, rows):
    refs = rf.vault_references(*vault(spark))
    assert rows(refs, "tab", "source_path", "target", "status") == sorted(
        [
            ("notes", "/v/a.md", "b", "ok"), ("notes", "/v/a.md", "c", "late"), ("notes", "/v/a.md", "weg", "deleted"), ("notes", "/v/a.md", "nie", "missing"), ("notes", "/v/a.md", "Weg", "missing"),
            ("notes", "/v/a.md", "x.y", "late"), ("notes", "/w/x.y.md", "a", "ok"), ("notes", None, "z", "missing"), ("chunks", "/v/a.md", "/v/a.md", "ok"), ("chunks", "/v/weg.md", "/v/weg.md", "deleted"),
            ("chunks", "/v/nie.md", "/v/nie.md", "missing"), ("chunks", "/v/c.md", "/v/c.md", "late"), ("chunks", "/v/b.md", "/v/b.md", "ok"),
        ],
        key=lambda t: tuple((x is None, str(x)) for x in t),
    )
    counts = rf.report(refs)
    assert counts.where("tab = 'chunks' and status = 'deleted' and month = '2025-02' and n_references = 1").count() == 1
    assert rf.dangling(refs).count() == 6


def test_empty_tables(spark):
    notes, chunks, feed = (df.limit(0) for df in vault(spark))
    refs = rf.vault_references(notes, chunks, feed)
    assert refs.count() == 0 and rf.report(refs).count() == 0 and rf.dangling(refs).count() == 0


def test_a_target_of_most_rows(spark):
    notes = spark.createDataFrame([(f"/v/n{i}.md", ["hot"], T(1), "", "") for i in range(2000)] + [("/v/m.md", ["hot", "n7"], T(1), "", "")], NOTES)
    refs = rf.note_references(notes)
    out = rf.classify(refs, rf._parents(rf.parent_intervals(notes), rf.file_stem(rf.F.col("path"))))
    assert out.where("status = 'missing'").count() == 2001 and out.where("status = 'ok'").count() == 1


def test_references_against_several_intervals(spark):
    t = lambda day: datetime(2025, 1, day)
    intervals = [("back", t(3), t(6)), ("back", t(9), None), ("gone", t(2), t(5)), ("gone", t(7), t(8)), ("twin", t(2), t(9)), ("twin", t(4), t(6))]
    asked = [("back", 2), ("back", 3), ("back", 6), ("back", 8), ("back", 9), ("gone", 1), ("gone", 4), ("gone", 5), ("gone", 7), ("gone", 20), ("twin", 7), ("none", 1), ("back", None), (None, 1)]
    refs = spark.createDataFrame([(k, None if d is None else t(d), i) for i, (k, d) in enumerate(asked)], "key string, at timestamp, n int")
    got = rf.classify_intervals(refs, spark.createDataFrame(intervals, "key string, valid_from timestamp, valid_to timestamp"))
    assert {r["n"]: r["status"] for r in got.collect()} == dict(enumerate(
        ["late", "ok", "away", "away", "ok", "deleted", "deleted", "after", "deleted", "after", "deleted", "missing", "ok", "missing"]
    ))
    none = spark.createDataFrame([], "key string, valid_from timestamp, valid_to timestamp")
    assert {r["status"] for r in rf.classify_intervals(refs, none).collect()} == {"missing"} and rf.classify_intervals(refs.limit(0), none).count() == 0


def test_presence_intervals_follow_the_feed(spark, rows):
    t = lambda day: datetime(2025, 1, day)
    feed = spark.createDataFrame([("a", "upsert", t(1)), ("a", "upsert", t(2)), ("a", "delete", t(3)), ("a", "delete", t(4)), ("a", "upsert", t(5)), ("b", "upsert", t(1)), ("b", "upsert", t(6)), ("c", "delete", t(1)), (None, "upsert", t(1)), ("d", "upsert", None)], "source_path string, op string, seen_at timestamp")
    notes = spark.createDataFrame([("a", t(5)), ("a", t(7)), ("e", t(2))], "source_path string, indexed_at timestamp")
    assert rows(rf.presence_intervals(notes, feed)) == [("a", t(1), t(3)), ("a", t(5), None), ("b", t(1), t(6)), ("e", t(2), None)]
