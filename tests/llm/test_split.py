import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mneme.llm import split as sp


def scan_max(values, low, high):
    best = low
    for i in range(low, high + 1):
        if values[i] >= values[best]:
            best = i
    return best


@given(st.lists(st.integers(-1, 6), min_size=1, max_size=300), st.data())
@settings(max_examples=60, deadline=None)
def test_sparse_table_equals_scan(values, data):
    import numpy as np

    table = sp.StrongestCut(np.array(values, np.int8), len(values))
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    assert table.between(low, high) == scan_max(values, low, high)


@given(st.text(alphabet="ab .\n#é日", max_size=900))
@settings(max_examples=60, deadline=None)
def test_pieces_cover_the_text_within_the_limit(text):
    pieces = sp.cut(text, 100, 20)
    bare = text.strip(sp.BLANKS)
    if not bare:
        assert pieces == []
        return
    assert text[pieces[0][0] : pieces[-1][1]] == bare
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= 20
    assert all(0 < b - a <= 100 for a, b in pieces)
    assert (len(pieces) > 1) == (len(bare) > 100)


def test_cuts_at_the_strongest_boundary_and_not_inside_characters():
    text = "x" * 60 + "\n\n" + "y" * 20 + ". " + "z" * 80
    assert sp.cut(text, 100, 0)[0] == (0, 62)
    accents = "é" * 200
    assert all(text[b : b + 1] != "́" for text in [accents] for a, b in sp.cut(accents, 101, 10))


def test_very_long_text_in_stretches():
    random.seed(1)
    text = " ".join(random.choice(["wort", "satz.", "absatz.\n\n"]) for _ in range(400_000))
    pieces = sp.cut(text)
    assert pieces[-1][1] == len(text.rstrip(sp.BLANKS)) and max(b - a for a, b in pieces) <= sp.LIMIT


def test_rejects_an_overlap_that_makes_no_progress():
    with pytest.raises(ValueError):
        sp.cut("a" * 100, 10, 5)


def test_operator_edge_cases(spark, rows):
    long = ("Satz eins. " * 400).strip()
    data = [("a", long, "H", 1), ("a", long, "H", 1), ("b", "kurz", None, 2), ("c", None, "H", 3), ("d", "", "H", 4), ("e", " \n\t", "H", 5), (None, long, "H", 6), ("f", "  " + "x" * 2800 + "\n", "H", 7)]
    df = spark.createDataFrame(data, "id string, text string, header string, piece int")
    out = sp.split(df, ["id"], ["header"])
    found = rows(out, "id", "piece", "n_pieces")
    assert [r for r in found if r[0] == "b"] == [("b", 1, 1)] and [r for r in found if r[0] == "f"] == [("f", 1, 1)]
    assert not [r for r in found if r[0] in ("c", "d", "e")]
    assert len([r for r in found if r[0] == "a"]) == 2 * len([r for r in found if r[0] is None]) > 2
    for r in out.where("id = 'a'").collect():
        assert r["piece_text"] == long[r["start_char"] : r["end_char"]] and r["header"] == "H" and len(r["piece_text"]) <= 2800
    assert sp.split(df.limit(0), ["id"], ["header"]).count() == 0
    with pytest.raises(ValueError):
        sp.split(df, ["id"], ["piece"])
    only = sp.split(df, ["id"], ["header"], only_oversized=True)
    assert {r["id"] for r in only.select("id").distinct().collect()} == {"a", None}
