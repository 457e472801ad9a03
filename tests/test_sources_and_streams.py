import json

import pytest
from pyspark.sql import functions as F

from mneme.functions import text as tx
from mneme.operators import evaluation, reports
from mneme.operators.changefeed import ManifestTable
from mneme.sources import files, markdown
from mneme.streaming import streams


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_notes_with_headers(spark, tmp_path):
    write(tmp_path, "a.md", "---\ndomain: haus\nupdated: 2025-01-02\ngeprueft: \"2025-01-03\"\nquelle:  eigene\n  Messung\n---\n# T\n[[b|x]]")
    write(tmp_path, "sub/b.md", "---\nindexed: False\n---\nweg")
    write(tmp_path, "sub/c.md", "---\ndomain: ''\nquelle: \"\"\n---\nx")
    write(tmp_path, "d.md", "ohne Kopf --- hier")
    write(tmp_path, ".obsidian/e.md", "versteckt")
    write(tmp_path, "f.txt", "anderes")
    out = {r["relative"]: r for r in markdown.read_notes(spark, str(tmp_path)).collect()}
    assert set(out) == {"a.md", "sub/b.md", "sub/c.md", "d.md"}
    a = out["a.md"]
    assert (a["domain"], a["updated"], a["geprueft"], a["quelle"], a["body"], a["links"]) == ("haus", "2025-01-02", "2025-01-03", "eigene Messung", "# T\n[[b|x]]", ["b"])
    assert out["sub/b.md"]["skip"] and out["sub/b.md"]["error"] is None and out["sub/c.md"]["error"] and out["sub/c.md"]["quelle"] is None and out["d.md"]["error"] and out["d.md"]["body"].startswith("ohne")


def test_pdfs_fail_one_by_one(spark, tmp_path):
    write(tmp_path, "x/a.pdf", "gut")
    write(tmp_path, "x/b.pdf", "kaputt")

    def parser(content):
        if b"kaputt" in content:
            raise ValueError("nope")
        return content.decode().upper()

    out = {r["path"].rsplit("/", 1)[1]: (r["markdown"], r["error"]) for r in files.parse_pdfs(files.scan_pdfs(spark, str(tmp_path)), parser).collect()}
    assert out == {"a.pdf": ("GUT", None), "b.pdf": (None, "ValueError: nope")}
    assert files.scan_pdfs(spark, str(tmp_path / "x/a.pdf")).count() == 1


def test_json_inputs(spark, tmp_path):
    write(tmp_path, "gold.jsonl", json.dumps({"id": "g1", "typ": "faktisch", "frage": "?", "soll": [{"notiz": "n", "beleg": "b"}]}) + "\n\n")
    gold = files.read_gold(spark, str(tmp_path / "gold.jsonl")).collect()
    assert len(gold) == 1 and gold[0]["darf_nicht"] == [] and gold[0]["soll"][0]["notiz"] == "n"
    hit = {"rank": 1, "score": 0.5, "id": "p", "text": "t"}
    for name, body in (("a.json", [hit]), ("b.json", {"query": "q", "chunks": [hit]}), ("c.json", {"query": "q", "results": [hit, hit]})):
        write(tmp_path, name, json.dumps(body, indent=1))
    assert files.read_hits(spark, str(tmp_path / "a.json")).first()["query"] is None and files.read_hits(spark, str(tmp_path / "b.json")).first()["id"] == "p" and files.read_hits(spark, str(tmp_path / "c.json")).count() == 2
    write(tmp_path, "cases.json", json.dumps({"version": 1, "cases": [{"id": "A1", "category": "A", "query": "q"}]}))
    assert files.read_cases(spark, str(tmp_path / "cases.json")).first()["category"] == "A"
    write(tmp_path, "runs/2025-01_x.jsonl", json.dumps({"case_id": "old"}))
    write(tmp_path, "runs/2025-02_x.jsonl", json.dumps({"case_id": "new"}))
    assert files.newest_run(spark, str(tmp_path / "runs"), "x").first()["case_id"] == "new"
    with pytest.raises(FileNotFoundError):
        files.newest_run(spark, str(tmp_path / "runs"), "y")


def test_log_stream_equals_batch(spark, tmp_path, rows):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), events.schema, 1)
    for name, make in (("w", lambda df: streams.log_windows(df, "ts", "1 day")), ("s", lambda df: streams.log_sessions(df, "ts", "user_id", "30 minutes", "40 days"))):
        q = make(stream).writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(f"log_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = rows(spark.table(f"log_{name}"))
        assert got == rows(make(events)) if name == "w" else set(got) <= set(rows(make(events)))


def test_notes_arrive_as_a_stream(spark, tmp_path, rows):
    schema = "source_path string, content_hash string, seen_at timestamp, text string"
    target = ManifestTable(spark, str(tmp_path / "points"), "point_id")

    def arrive(name, data):
        spark.createDataFrame(data, "source_path string, content_hash string, t string, text string").selectExpr("source_path", "content_hash", "cast(t as timestamp) as seen_at", "text").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    calls = []

    def to_points(batch):
        calls.append(batch.count())
        parts = batch.select("source_path", "content_hash", F.posexplode(F.split("text", " ")).alias("chunk_id", "text"))
        return parts.withColumn("point_id", tx.point_id(F.col("source_path"), F.col("chunk_id")))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        streams.ingest_stream(stream, target, str(tmp_path / "cp"), to_points).awaitTermination()

    arrive("1", [("/a", "h1", "2025-01-01", "x y z"), ("/b", "h2", "2025-01-01", "q"), ("/a", "h0", "2024-01-01", "alt")])
    run()
    assert rows(target.read(), "source_path", "text") == [("/a", "x"), ("/a", "y"), ("/a", "z"), ("/b", "q")]
    arrive("2", [("/a", "h3", "2025-01-02", "neu"), ("/b", "H2", "2025-01-02", "q")])
    run()
    assert rows(target.read(), "source_path", "text") == [("/a", "neu"), ("/b", "q")] and calls == [2, 1]
    version = target.latest()
    run()
    assert target.latest() == version


def test_graph_and_item_reports(spark, rows):
    notes = spark.createDataFrame([("/v/a.md", ["b", "x"]), ("/v/b.md", ["b"]), ("/v/c.md", None), ("/v/d.md", [])], "source_path string, links array<string>")
    assert rows(reports.dead_links(notes)) == [("a", "x")] and rows(reports.orphans(notes)) == [("a",), ("c",), ("d",)] and rows(reports.dead_ends(notes)) == [("c",), ("d",)]
    assert rows(reports.most_linked(notes)) == [("b", 2)] and reports.graph_totals(notes).first().asDict() == {"notes": 4, "links": 3, "dead_links": 1, "orphans": 3, "dead_ends": 2}
    text = "# Offen\n- 🔴 **Titel.** mehr **fett** (seit 2025-06-30)\n  weiter\n- [x] ~~**Alt**~~\n- ⚠️ ohne Datum (seit 2025-13-01)\n- " + "l" * 90
    items = reports.items_from(spark.createDataFrame([("n", text, "a")], "note string, text string, domain string"), "note", "text", "Offen", "domain")
    got = {r["title"]: r for r in items.collect()}
    assert set(got) == {"Titel", "Alt", "ohne Datum (seit 2025-13-01)", "l" * 70} and got["Titel"]["since"] == "2025-06-30" and got["Titel"]["text"] == "**Titel.** mehr **fett**   weiter"
    ordered = reports.ordered_items(items, F.lit("2025-07-01").cast("date")).orderBy("position").collect()
    assert [r["marker"] for r in ordered] == ["🔴", "⚠️", ""] and [r["age_days"] for r in ordered] == [1, None, None]
    assert reports.item_totals(items).first().asDict() == {"done": 1, "open": 3, "undated": 1}


def test_runtime_figures(spark):
    log = spark.createDataFrame([(i, float(i)) for i in range(1, 301)], "id int, ms double")
    r = reports.latency_stats(log, ["id"], "ms").first()
    assert (r["samples"], r["max"], r["p50"]) == (256, 300.0, 172.0)
    assert reports.latency_stats(log.limit(0), ["id"], "ms").first()["p50"] is None
    assert reports.runtime_totals(log.limit(0), F.lit(True), F.lit(True)).first()["cache_hit_rate"] == 0.0


def test_evaluation_of_a_small_case(spark):
    cases = spark.createDataFrame([("g1", "faktisch", "?", [("n1", "der  Beleg")], ["bad"]), ("g2", "negativ", "?", [], [])], "id string, typ string, frage string, soll array<struct<notiz:string,beleg:string>>, darf_nicht array<string>")
    hits = spark.createDataFrame([("g1", 1, "n2", "x", 0.9), ("g1", 2, "n1", "hier der\nBeleg!", 0.8), ("g1", 3, "n1", "nichts", 0.7), ("g1", 4, "bad", "y", 0.6), ("g2", 1, "n1", "z", 0.5)], "case_id string, rank int, note string, text string, score double")
    scored = evaluation.score_cases(evaluation.select_variants(hits), cases)
    k10 = scored.where("variant = 'k10' and case_id = 'g1'").first()
    assert (k10["note_rank"], k10["passage_rank"], k10["coverage"], k10["repeats"], k10["leaks"]) == (2, 2, 1.0, 1, ["bad"])
    assert scored.where("variant = 'k5_max1' and case_id = 'g1'").first()["repeats"] == 0
    s = evaluation.summarize(scored).where("variant = 'k10' and typ is null").first()
    assert (s["cases"], s["mrr"], s["passage_recall_1"], s["passage_recall_3"], s["leaks"]) == (2, 0.5, 0.0, 1.0, 1)
    notes = spark.createDataFrame([("n1", "alles anders")], "note string, text string")
    assert [r["id"] for r in evaluation.orphaned_cases(cases, notes).collect()] == ["g1"]


@pytest.mark.parametrize(
    "raw, want", [('{"label": " relevant "}', "RELEVANT"), ('{"label": "x"} [IRRELEVANT]', "IRRELEVANT"), ("Ich meine [TEILWEISE_RELEVANT].", "TEILWEISE_RELEVANT"), ("nichts", "PARSING_FAILED"), ("[UNBEKANNT]", "PARSING_FAILED")]
)
def test_judge_labels(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(evaluation.judge_label(F.col("r"), evaluation.LABELS["context_relevance"])).first()[0] == want
