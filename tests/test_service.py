import pytest
from pyspark.sql import functions as F

from mneme import models, schemas
from mneme.operators import evaluation, index, reports
from mneme.service import Vault

NOTE = "---\ndomain: {d}\nquelle: eigene\n---\n# {t}\n{b}\n"


@pytest.fixture
def vault(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "heizung.md").write_text(NOTE.format(d="haus", t="Heizung", b="Die Heizung braucht neues Wasser. [[garten]]\n## Offen\n- 🔴 **Ventil.** tauschen (seit 2025-06-01)\n- ohne Datum"))
    (notes / "garten.md").write_text(NOTE.format(d="garten", t="Garten", b="Im Garten wachsen Tomaten und Kürbisse. [[fehlt]]"))
    (notes / "server.md").write_text(NOTE.format(d="infra", t="Server", b="Der Server sichert jede Nacht die Daten."))
    (notes / "privat.md").write_text("---\nindexed: false\n---\ngeheim")
    (notes / "kaputt.md").write_text("---\nquelle: x\n---\nohne Bereich")
    return Vault(spark, str(tmp_path / "tables")), notes


def statuses(report):
    return {r["source_path"].rsplit("/", 1)[1]: r["status"] for r in report.collect()}


def test_ingest_search_and_change(vault):
    v, notes = vault
    assert statuses(v.ingest(str(notes))) == {"heizung.md": "indexed", "garten.md": "indexed", "server.md": "indexed", "privat.md": "skipped", "kaputt.md": "error"}
    assert v.points().count() == 4
    hits = v.search([("Wasser für die Heizung", None), ("Tomaten im Garten", "garten"), ("Tomaten", "haus")], top_k=2).collect()
    best = {r["query_id"]: r for r in hits if r["rank"] == 1}
    assert best[0]["source"].endswith("heizung.md") and best[1]["source"].endswith("garten.md") and {r["domain"] for r in hits if r["query_id"] == 2} == {"haus"} and not any(r["cache_hit"] for r in hits)
    again = v.search([("  WASSER für die heizung", None)], top_k=2).collect()
    assert all(r["cache_hit"] for r in again) and [r["id"] for r in sorted(again, key=lambda r: r["rank"])] == [r["id"] for r in sorted(hits, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert set(statuses(v.ingest(str(notes))).values()) == {"unchanged", "skipped", "error"}
    (notes / "heizung.md").write_text(NOTE.format(d="infra", t="Heizung", b="Ganz neu."))
    (notes / "server.md").write_text("---\nindexed: false\n---\nweg")
    assert statuses(v.ingest(str(notes)))["heizung.md"] == "indexed"
    assert {(r["domain"], r["n"]) for r in v.domains().collect()} == {("garten", 1), ("infra", 1)}
    assert not any(r["cache_hit"] for r in v.search([("wasser für die heizung", None)], top_k=2).collect())
    assert set(statuses(v.ingest(str(notes), force=True)).values()) == {"indexed", "skipped", "error"}
    s = v.stats().first()
    assert (s["searches"], s["cache_hits"], s["points"], s["domains"]) == (5, 1, 2, 2)
    path = v.notes("infra").first()["source_path"]
    assert v.delete(path) == 1 and v.delete(path) == 0 and v.notes().count() == 1 and v.health()["points"] >= 4


def test_ask_related_reports_and_compression(vault):
    v, notes = vault
    v.ingest(str(notes))
    answers = {r["query_id"]: r["answer"] for r in v.ask([("Was braucht die Heizung?", None), ("Nichts", "unbekannt")]).collect()}
    assert len(answers) == 2 and "Keine" in answers[1]
    near, linked = v.find_related(v.notes("haus").first()["source_path"], 2)
    assert near.count() == 2 and near.where(F.col("source_path").endswith("heizung.md")).count() == 0 and [r["direction"] for r in linked.collect()] == ["outgoing"]
    g = v.graph_check().first()
    assert (g["notes"], g["dead_links"], g["orphans"]) == (3, 1, 2)
    items = v.open_items(str(notes), "Offen", F.lit("2025-07-01").cast("date"))
    text = reports.items_text(items, markdown=True)
    assert "indexed: false" in text and "Ventil (heizung.md, 30 Tage)" in text and "ohne Datum" in text
    cut = v.search([("neues Wasser", None)], 1, budget=100, use_cache=False).first()
    assert cut["text"].startswith("# Heizung") or "Wasser" in cut["text"]
    assert v.clean_cache() >= 0
    with pytest.raises(ValueError):
        v.search([("", None)])
    with pytest.raises(ValueError):
        v.search([("x", None)], top_k=51)
    scored = Vault(v.spark, v.root, scorer=models.overlap_scorer).search([("Wasser Heizung", None)], 3, use_cache=False)
    assert scored.where("rank = 1").first()["rerank_score"] == 1.0


def test_smaller_operators(spark, rows):
    offsets = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 5), (0, 2, 5, 9), (0, 3, 9, 12)], "window int, token int, off_start int, off_end int")
    chunks = spark.createDataFrame([(0, 0, 0, 6), (0, 1, 6, 12), (0, 2, 50, 60)], "window int, chunk_id int, char_start int, char_end int")
    assert rows(index.token_overlap(offsets, chunks), "chunk_id", "token") == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    weights = spark.createDataFrame([(0, 7, -1.0), (0, 7, 2.0), (0, 7, 1.0), (0, 8, -2.0)], "chunk_id int, token_id int, weight double")
    assert rows(index.pool_sparse(weights)) == [(0, 7, 2.0)]
    hits = spark.createDataFrame([("g", 1, "note-x", "Alpha"), ("g", 2, "y", "beta")], "case_id string, rank int, note string, text string")
    cases = spark.createDataFrame([("g", "BETA", "gamma", "note")], "case_id string, expected_keyword string, expected_secondary_keyword string, expected_source string")
    r = evaluation.rank_only(hits, cases).first()
    assert (r["keyword_rank"], r["secondary_rank"], r["source_in_top3"]) == (2, None, True)
    texts = spark.createDataFrame([("n", "# Offen\n## Offene Fragen\n## Nächste Schritte\n### ganz langer Titel über offene Dinge\n## Fertig")], "note string, text string")
    assert rows(reports.heading_hints(texts, "note", "text", ("Nächste Schritte",))) == [("n", "Offene Fragen")]
    meta = schemas.metadata(spark.createDataFrame([("p", "t", 0.5, "haus", None)], "id string, text string, score double, domain string, quelle string")).first()
    assert meta["metadata"] == '{"domain":"haus"}'
    with pytest.raises(ValueError):
        schemas.check_width(spark.createDataFrame([([[1.0], [1.0, 2.0]],)], "colbert array<array<float>>"), 1)
    judged = evaluation.judge_cases(spark.createDataFrame([("a",)], "id string"), {m: F.lit(v[0]) for m, v in evaluation.LABELS.items()}, lambda prompts: [f"[{p}]" for p in prompts])
    assert judged.first()["overall_pass"] is True
    assert evaluation.category_stats(spark.createDataFrame([("A", True), ("A", False)], "category string, passed boolean")).first()["passed"] == 1


def test_a_chunk_with_too_many_words_is_refused(spark):
    import pytest
    from pyspark.sql import functions as F

    from mneme import models
    from mneme.operators import index

    df = spark.createDataFrame([("a b " * 600, 0, "n.md", "h", "s", "t")], "text string, chunk_id int, source string, header string, section_id string, document_title string")
    embedded = models.encode_all(df, F.col("text"))
    assert embedded.select(F.size("colbert")).first()[0] == 1200
    columns = "links array<string>, updated string, geprueft string, quelle string"
    for column in columns.split(", "):
        name, kind = column.split(" ")
        embedded = embedded.withColumn(name, F.lit(None).cast(kind))
    with pytest.raises(Exception, match="chunk too large"):
        index.build_points(embedded, F.col("source"), F.lit("d"), F.lit("r"), F.lit("h")).collect()


def test_decomposed_questions_are_fused_and_counted(vault):
    v, notes = vault
    v.ingest(str(notes))
    parts = Vault(v.spark, v.root, generator=lambda prompts: ['Gern: ["Wasser für die Heizung", "Tomaten im Garten"]' if "Heizung und Garten" in p else "weiß nicht" for p in prompts])
    hits = parts.search([("Heizung und Garten", None), ("Server Daten", None)], top_k=2, decompose=True).collect()
    fused = sorted((r["rank"], r["source"].rsplit("/", 1)[1], r["score"]) for r in hits if r["query_id"] == 0)
    assert {s for _, s, _ in fused} == {"heizung.md", "garten.md"} and all(0 < score < 0.06 for *_, score in fused)
    single = next(r for r in hits if r["query_id"] == 1 and r["rank"] == 1)
    assert single["source"].endswith("server.md") and single["score"] > 0.5
    # the sub-questions are in the cache now; their uses are counted
    again = v.search([("Wasser für die Heizung", None)], top_k=2).collect()
    assert all(r["cache_hit"] for r in again)
    s = v.stats().first()
    assert s["cached_results"] == 4 and s["cache_uses"] == 1 and s["searches"] == 3


def test_deleting_a_note_forgets_the_results_that_may_hold_it(vault):
    v, notes = vault
    v.ingest(str(notes))
    v.search([("Wasser", "haus"), ("Tomaten", "garten"), ("Daten", None)], top_k=1)
    assert v.stats().first()["cached_results"] == 3
    v.delete(v.notes("haus").first()["source_path"])
    assert {r["domain"] for r in v._cache.read().collect()} == {"garten"}
    v.maintain()
    assert v.notes().count() == 2 and v.stats().first()["cached_results"] == 1


def test_pdf_files_and_late_chunks(vault, tmp_path):
    v, _ = vault
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "plan.pdf").write_bytes(b"# Plan\nDas Fundament steht.\n## Dach\nZiegel fehlen.")
    (tmp_path / "pdf" / "leer.pdf").write_bytes(b"kaputt")
    with pytest.raises(ValueError):
        v.ingest_pdfs(str(tmp_path / "pdf"), "bau")

    def parser(content):
        if content == b"kaputt":
            raise OSError("no pages")
        return content.decode()

    read = Vault(v.spark, v.root, pdf_parser=parser, late=models.word_tokens)
    assert statuses(read.ingest_pdfs(str(tmp_path / "pdf"), "bau")) == {"plan.pdf": "indexed", "leer.pdf": "error"}
    assert statuses(read.ingest_pdfs(str(tmp_path / "pdf"), "bau")) == {"plan.pdf": "unchanged", "leer.pdf": "error"}
    points = read.points().collect()
    (roof,) = [r for r in points if r["header"] == "Dach"]  # read with its heading line: Plan › Dach, Dach, Ziegel fehlen
    assert {r["header"] for r in points} == {"Plan", "Dach"} and (len(roof["dense"]), len(roof["colbert"]), len(roof["sparse"])) == (16, 5, 4)


def test_a_gold_set_is_searched_and_judged(vault):
    v, notes = vault
    v.ingest(str(notes))
    rows = [("g1", "faktisch", "Was braucht die Heizung an Wasser?", [("heizung", "neues Wasser")], ["garten"]), ("g2", "negativ", "Mars?", [], [])]
    cases = v.spark.createDataFrame(rows, schemas.GOLD_CASE)
    scored = {(r["variant"], r["case_id"]): r for r in v.evaluate(cases).collect()}
    assert scored["k5", "g1"]["passage_rank"] == 1 and scored["k5", "g1"]["coverage"] == 1.0 and scored["k10", "g1"]["leaks"] == ["garten"]
    assert "| k10 |" in evaluation.report_text(evaluation.summarize(v.evaluate(cases)))
    seen = []

    def judge(prompts):
        return ['{"label": "relevant"}' if "Frage hilft" in p or "ob der Kontext" in p else "[VOLLSTÄNDIG_BELEGT]" if "jede Aussage" in p else "[BEANTWORTET]" for p in prompts]

    judged = {r["case_id"]: r for r in v.judge(cases, judge).collect()}
    assert judged["g1"]["overall_pass"] and judged["g1"]["groundedness"] == "VOLLSTÄNDIG_BELEGT" and seen == []
    empty = v.spark.createDataFrame([("e", "", ["x"], "a"), ("f", "q", [], "a")], "case_id string, question string, contexts array<string>, answer string")
    assert [r["overall_pass"] for r in evaluation.judge_answers(empty, judge).collect()] == [False, False]
