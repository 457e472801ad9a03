import pytest

from mneme.llm import markup as mk


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("a <b>x</b>", {"html"}), ("<!-- note -->", {"html"}), ("x &amp; y", {"html"}), ("&#8230;", {"html"}), ("<TABLE><TR><TD>x</TABLE>", {"html"}), ("<img\n src='a.png'\n/>", {"html"}),
        ("'''fett'''", {"wiki"}), ("''kursiv''", {"wiki"}), ("x\n== Titel ==\ny", {"wiki"}), ("=== T 7 ===", {"wiki"}), ("{{Hinweis|a|b=1}}", {"wiki"}), ('{| class="w"\n! a !! b\n|-\n| c || d\n|}', {"wiki"}),
        ("[[Datei:B.png|thumb|x]]", {"wiki"}), ("[[Kategorie:Haus]]", {"wiki"}), ("__TOC__", {"wiki"}),
        ("\\section{A}", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("$x_1 = 2$", {"latex"}), ("$$\\sum x$$", {"latex"}), ("\\(a+b\\)", {"latex"}), ("\\[ a \\le b \\]", {"latex"}), ("Text~\\cite{k1}", {"latex"}),
        ("5 < 7 und 9 > 3", set()), ("Preis: $127, dort: $134", set()), ("C:\\daten\\begin\\x", set()), ("$HOME/x ${Y} 'z'", set()), ("==markiert==", set()), ("siehe [[notiz]] und [[notiz#a|b]]", set()),
        ("`<b>x</b>` und ``{{x}}``", set()), ("```html\n<p>x</p>\n```", set()), ("~~~\n\\section{x}\n$a_1$", set()), ("# Titel\n- [ ] Punkt\n> Zitat\n| a | b |\n|---|---|", set()), ("AT&T; und R&D", set()), ("<https://a.b/c> <a@b.de>", set()),
        ("It's a 5'' disk", set()), ("__init__ und __fett__", set()), ("<name> als Platzhalter", set()), ("\\* kein \\_ Befehl", set()), ("", set()),
    ],
)
def test_kinds(text, kinds):
    assert {t.kind for t in mk.tokens(text)} == kinds


def test_wrapper_inference_finds_repeats_and_options():
    item = ["<li>", "#", "</li>"]
    assert mk.infer([["<ul>", *item, "</ul>"], ["<ul>", *item, *item, *item, "</ul>"]]) == ["<ul>", ["+", item], "</ul>"]
    both = mk.infer([["<p>", "#", "</p>"], ["<p>", "#", "<b>", "#", "</b>", "</p>"]])
    assert mk.reads(both, ["<p>", "#", "</p>"]) and mk.reads(both, ["<p>", "#", "<b>", "#", "</b>", "</p>"]) and not mk.reads(both, ["<p>", "#"])


def test_wrappers_read_their_own_samples():
    import random

    rng = random.Random(4)
    for _ in range(200):
        samples = []
        for _ in range(rng.randint(1, 6)):
            rows = [["<tr>"] + ["<td>", "#", "</td>"] * rng.randint(1, 3) + ["</tr>"] for _ in range(rng.randint(0, 3))]
            samples.append(["<table>"] + (["<caption>", "#", "</caption>"] if rng.random() < 0.4 else []) + sum(rows, []) + ["</table>"])
        wrapper = mk.infer(samples)
        assert all(mk.reads(wrapper, s) for s in samples)


def test_long_streams_are_aligned_like_short_ones():
    import random
    from difflib import SequenceMatcher

    for n in (20, 2100):
        one = [f"\\c{i}{{}}" for i in range(n)]
        other = [*one[:7], "\\other{}", *one[8:]]
        assert mk.align(one, other) == [*one[:7], ["?", [one[7]]], ["?", ["\\other{}"]], *one[8:]]
    rng = random.Random(5)
    single = lambda blocks: [(i + k, j + k) for i, j, n in blocks for k in range(n)]
    for _ in range(500):
        a, b = (rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(0, 30)) for _ in range(2))
        assert single(mk._shared(a, b)) == single(SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_alignment_of_nested_elements_ends():
    samples = [["<li>"] * 3 + ["</li>"] * 3, ["<li>", "</li>"]]
    wrapper = mk.infer(samples)
    assert all(mk.reads(wrapper, s) for s in samples)


def test_clean_text_keeps_structure():
    assert mk.clean("<h2>Titel</h2>\n<ul><li>a</li><li>b &amp; c</li></ul>") == "## Titel\n\n- a\n- b & c"
    assert mk.clean("<table><tr><td>1</td><td>2</td></tr></table>").strip() == "| 1 | 2 |"
    assert mk.clean("== Teil ==\n'''fett''' und ''schräg''") == "## Teil\n**fett** und *schräg*"
    assert mk.clean("\\section{Eins}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}").split("\n")[0] == "## Eins"
    assert "- a" in mk.clean("\\begin{itemize}\n\\item a\n\\end{itemize}") and "$$ \\sqrt{2} $$".replace(" ", "") in mk.clean("\\[ \\sqrt{2} \\]").replace(" ", "")
    code = "```html\n<p>x</p>\n```\n`<b>`"
    assert mk.clean(code) == code and mk.clean("<pre><code>a < b\n</code></pre>").strip() == "```\na < b\n```"
    assert mk.clean("<TABLE><TR><TD>1<TD>2<TR><TD>3</TABLE>").split() == "| 1 | 2 | | 3 |".split() and mk.clean("Text.~\\cite{k}") == "Text. [k]"
    table = mk.clean('{| class="w"\n! a !! b\n|-\n| c || d\n|}')
    assert table == "| a | b |\n|---|---|\n| c | d |"


def test_operator_edge_cases(spark, rows):
    data = [
        ("a", "h1", "<p>x</p>\n\n'''y'''", 1), ("a", "h1", "<p>x</p>\n\n'''y'''", 2), ("b", None, "$a_1$", 1), ("c", "h1", None, 1), ("d", "h1", "", 1), ("e", "h1", "nur Text", 1), ("long", "h2", "<b>x</b> " * 20_000, 1), ("open", "h2", "{{ '' <!-- \\begin{", 1),
    ]
    df = spark.createDataFrame(data, "id string, host string, text string, kind int")
    found = rows(mk.residue(df, "id", "host").select("key", "kind").distinct())
    assert found == [("a", "html"), ("a", "wiki"), ("b", "latex"), ("long", "html")]
    assert mk.residue(df, "id", "host").where("not matched").count() == 0
    out = {r["id"]: r for r in mk.clean_texts(df.drop("kind"), "id", "host").collect()}
    assert set(out) == {"a", "b", "c", "d", "e", "long", "open"} and out["a"]["clean"] == "x\n\n**y**" and out["e"]["clean"] == "nur Text" and out["c"]["clean"] is None
    assert out["a"]["kinds"] == ["html", "wiki"]
    assert mk.residue(df.limit(0), "id", "host").count() == 0 and mk.clean_texts(df.limit(0), "id", "host").count() == 0


def test_folding_in_parts_gives_one_wrapper_per_host(spark, monkeypatch):
    monkeypatch.setattr(mk, "FOLD", 3)
    data = [(f"k{i}", "h", "<ul>" + "<li>x</li>" * (i % 5 + 1) + ("<hr>" if i % 2 else "") + "</ul>") for i in range(30)]
    df = spark.createDataFrame(data, "id string, host string, text string")
    assert mk.wrappers(mk.block_streams(df, "id", "host")).count() == 1 and mk.residue(df, "id", "host").where("matched").count() == 30


def test_wrapper_of_a_host_does_not_depend_on_the_number_of_other_streams(spark, rows):
    import random

    rng = random.Random(2)
    part = lambda: "".join(rng.choices(["<li>x</li>", "<hr>", "<b>x</b>", "<br>", "x"], k=rng.randint(1, 9)))
    own = [(f"k{i}", "h", f"<ul>{part()}</ul>") for i in range(60)]
    others = [(f"o{i}", f"o{i % 20}", "\\x{y} \\c" + "".join(chr(97 + int(c)) for c in str(i)) + "{y}") for i in range(2000)]
    got = [
        rows(mk.wrappers(mk.block_streams(spark.createDataFrame(data, "id string, host string, text string"), "id", "host")).where("host = 'h'"))
        for data in (own, own + others)
    ]
    assert got[0] == got[1] and len(got[0]) == 1
