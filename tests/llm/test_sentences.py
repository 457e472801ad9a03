import numpy as np
import pytest

from mneme.llm import sentences as se

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    import duckdb

    texts = duckdb.connect().execute(f"select text, fmt from '{DATA}/documents.parquet' where text is not null order by doc_id").fetchall()
    stats = se.Statistics()
    for text, fmt in texts:
        stats.add(text, fmt == "note")
    rows = sorted(e for text, fmt in texts for e in se.examples(text, fmt == "note", stats))
    held, train = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    weights = se.train(np.array([r[0] for r in train]), np.array([r[1] for r in train]))
    return stats, weights, held


def cut(text, model, markdown=False):
    return [text[a:b] for a, b in se.boundaries(text, markdown, model[0], model[1])]


def test_held_out_accuracy(model):
    stats, weights, held = model
    right = sum((weights[x].sum() > 0) == y for y, x in held)
    assert len(held) > 1000 and right / len(held) > 0.99


@pytest.mark.parametrize(
    "sentences",
    [
        ["Das kostet ca. 5,3 Euro inkl. MwSt. und mehr.", "Dr. Meier prüft es."], ["Im Ordner liegen u. a. x-1.conf und Teile usw.", "Der Rest fehlt."], ["„Läuft das noch?“, fragt der Dienst.", "Die Karte schweigt."],
        ["(Siehe dazu Bild, S. 12 ff.)", "Der Router hilft."], ["Am 2. September kopiert das Brot den Ordner.", "Warum?"], ["It stores ... well, the rest.", "Really 12 entries?!", "Yes."], ["Version 4.0.1 helps vs. the other one.", "It works."],
    ],
)
def test_known_traps(sentences, model):
    assert cut(" ".join(sentences), model) == sentences


def test_scripts_without_spaces(model):
    assert cut("今日は動く。「動くか？」とモデルが聞く。終わり！", model) == ["今日は動く。", "「動くか？」とモデルが聞く。", "終わり！"]


def test_marks_of_further_scripts(model):
    for text in ["Սա նախադասություն է։ Սա ևս մեկն է։", "ይህ ዓረፍተ ነገር ነው። ይህ ሌላ ነው።", "ဒါက စာကြောင်းပါ။ နောက်တစ်ကြောင်းပါ။", "នេះជាប្រយោគ។ នេះជាប្រយោគមួយទៀត។"]:
        assert len(cut(text, model)) == 2


def test_operator_equals_a_loop_over_the_texts(spark, rows):
    """The scan, written once, and the decisions per combination of signs give what each text gives alone."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 4 = 0 and text is not null").select("doc_id", "text", "fmt")
    md = F.col("fmt") == "note"
    data = se._rows(docs, "doc_id", "text", md, F.lit(True))
    counts, weights = se.learn(data, se.scanned(data, False))
    stats = se.Statistics(counts)
    want = sorted((r["k"], i + 1, a, b) for r in data.collect() for i, (a, b) in enumerate(se.boundaries(r["t"], r["md"], stats, weights)))
    got = se.sentences(docs, "doc_id", "text", md).collect()
    assert sorted((r["doc_id"], r["sentence_no"], r["start_char"], r["end_char"]) for r in got) == want and len(want) > 2000
    text = {r["k"]: r["t"] for r in data.collect()}
    assert all(r["sentence"] == text[r["doc_id"]][r["start_char"] : r["end_char"]] for r in got)
    assert se.sentences(docs, "doc_id", "text", md, only=F.col("fmt") == "plain").select("doc_id").distinct().count() == docs.where("fmt = 'plain' and trim(text) <> ''").count()


def test_blank_lines_line_breaks_and_ends(model):
    text = "  Ohne Punkt\n\nZwei\nZeilen hier.\r\n\r\n \n.. \n\n"
    found = se.boundaries(text, False, model[0], model[1])
    assert [text[a:b] for a, b in found][:2] == ["Ohne Punkt", "Zwei\nZeilen hier."]
    assert all(text[a:b] == text[a:b].strip() for a, b in found)


def test_markdown_blocks(model):
    text = "# Titel\n- Punkt eins\n- Punkt zwei. Mehr davon.\n```\na. B. c.\n```\nSchluss."
    assert cut(text, model, True) == ["# Titel", "- Punkt eins", "- Punkt zwei.", "Mehr davon.", "```\na. B. c.\n```", "Schluss."]


def test_sentences_cover_all_text(model):
    import duckdb

    for (text,) in duckdb.connect().execute(f"select text from '{DATA}/documents.parquet' where text is not null limit 300").fetchall():
        found = se.boundaries(text, False, model[0], model[1])
        covered = "".join(text[a:b] for a, b in found)
        assert "".join(covered.split()) == "".join(text.split()) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))


def test_operator_edge_cases(spark, rows):
    data = [(1, "Ein Satz. Noch einer.", "x"), (1, "Ein Satz. Noch einer.", "x"), (2, None, "x"), (3, "", "x"), (4, " \n\n ", "x"), (5, "Wort. " * 50_000, "x"), (6, '"' * 3000 + ". A", "x"), (None, "Ohne Schlüssel. Zwei.", "x")]
    df = spark.createDataFrame(data, "id long, text string, sentence string")
    out = se.sentences(df, "id")
    got = rows(out, "id", "end_char")
    assert [r for r in got if r[0] == 1] == [(1, 21), (1, 21), (1, 9), (1, 9)]
    assert not [r for r in got if r[0] in (2, 3, 4, None)] and len([r for r in got if r[0] == 5]) == 50_000
    assert se.sentences(df.limit(0), "id").count() == 0


def test_never_ending_tokens_are_labelled():
    stats = se.Statistics()
    for i in range(60):
        stats.add(f"Das kostet ca. Firma{i} sehr viel.\n\nEin Ende.", False)
    text = "Das kostet ca. Firma sehr viel."
    c = next(iter(se.candidates(text, 0, len(text))))
    assert stats.never_ends(c) and se.label(c, stats) is False
