"""Sentence boundaries across languages and scripts: a maximum-entropy classifier of candidates.

Every run of sentence marks with the closing quotes and brackets behind it is a candidate, unless a
lower-case letter or a digit follows without a space. A logistic model classifies each from its
neighbourhood: the mark, the token before (its shape, length and how often it ends a paragraph when
a mark follows it), the token behind (its case and script and how often it starts a paragraph),
digits, spaces and closing signs. The counts cover the whole corpus; they live in ``SLOTS`` hashed
counters, so their size is fixed. The model is trained here, without hand-made labels, on reliable
boundaries: marks at the end of a paragraph are boundaries (followed, for the features, by the first
token of the next paragraph), marks before a comma, before a lower-case word that starts no
paragraphs, and between tokens that often stand so and never end (or start) a paragraph are none. About ``TRAIN_DOCUMENTS`` documents, drawn by hash, give training rows, each of them about ``TRAIN_ROWS`` at most (of longer ones, paragraphs are drawn by hash).

Every text is scanned once: counters and candidates, each with its place and the few signs that decide
it, are written together. The decisions are then made per distinct combination of signs.

A blank line always ends a sentence, and so does the end of the text; in Markdown (``blocks``)
headings, list items, table rows and quotes do, too, and fenced code is one unit. Null, empty and
blank texts have no sentences; repeated rows give repeated sentences; rows without key are left out; texts of any length are read
whole, paragraph by paragraph. With too few reliable boundaries the model falls back to its prior:
a mark before white space ends a sentence unless a lower-case word follows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mneme.storage import materialize, spread

#: Hashed counters per statistic, hashed feature weights, documents that give training rows.
SLOTS, WEIGHTS, TRAIN_DOCUMENTS, TRAIN_ROWS = 1 << 19, 1 << 16, 4000, 500
#: Occurrences from which a token's own rate is trusted, where a third of all marks end a paragraph.
FREQUENT = 8
#: Expected ends (starts) of a paragraph from which a token that has none is a reliable non-boundary.
NEVER_ENDS, NEVER_STARTS = 10, 35
#: Counters that travel to the driver as one value.
PACKED = 1 << 15
#: Stands for all tokens in the counters.
_ANY = "\0"

#: Marks that end a sentence: Latin, Chinese and Japanese, Indic, Arabic, Armenian, Ethiopic, Burmese, Khmer, Tibetan, Sinhala.
_MARKS = ".!?…。！？｡।॥؟۔։።፧፨။។៕།༎෴"
_MARK = re.compile(f"[{_MARKS}]+")
_BLANK = re.compile(r"\n(?:[^\S\n]*\n)+")
_MARKDOWN = re.compile(r"^[ \t]*(?:#{1,6}[ \t]|[-*+][ \t]|\d{1,3}[.)][ \t]|>|\|)", re.M)
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_OUT = r"\s.,;:!?…。！？｡।॥؟۔։።፧፨။។៕།༎෴،؛()\[\]{}\"'“”„‚‘’«»‹›「」『』（）、，；：/*_|<>"
_TOKEN = re.compile(rf"[{_CJK}]|[^{_OUT}{_CJK}]+")
_OPENING = "\"'“„‚‘«‹「『（([{¿¡*_"
_CLOSING = "\"'”’»›」』）)]}“‘«*_"
#: What is skipped on the way to the token behind; what may follow a space or line break and still close.
_BEFORE_TOKEN, _CLOSING_BEHIND = frozenset(_OPENING + " \u00a0\u202f#"), frozenset("»」』”）")
_PAIRS = {"“": "„", "‘": "‚", "«": "»"}
_SPACE = re.compile(r"\s+")
#: A decimal that a line break inside a text without spaces has cut.
_BROKEN, _CHARACTER = re.compile(r"\d\.\n\d"), re.compile(f"[{_CJK}]")


@lru_cache(200_000)
def _slots(token: str) -> tuple[int, int]:
    """A token's place in either half of the counters; the lesser count holds, so one collision does no harm."""
    h = xxhash.xxh3_64_intdigest(token)
    return h & (SLOTS // 2 - 1), SLOTS // 2 + (h >> 32 & (SLOTS // 2 - 1))


def paragraphs(text: str, markdown: bool) -> Iterator[tuple[int, int]]:
    """Stretches that no sentence crosses, without white space at either end."""
    stops = {m.start() for m in _BLANK.finditer(text)}
    code: list[tuple[int, int]] = []
    if markdown:
        code = [m.span() for m in _FENCE.finditer(text)]
        lines = [m.start() for m in _MARKDOWN.finditer(text)]
        stops |= set(lines) | {text.find("\n", s) for s in lines if text[s : s + 16].lstrip(" \t")[:1] in "#|"} - {-1}
        begins = [a for a, _ in code]
        inside = lambda s: (k := bisect_left(begins, s)) > 0 and s < code[k - 1][1]
        stops = {s for s in stops if not inside(s)} | {x for span in code for x in span}
    at = 0
    for stop in [*sorted(stops), len(text)]:
        part = text[at:stop]
        bare = part.strip()
        if bare:
            start = at + len(part) - len(part.lstrip())
            yield start, start + len(bare)
        at = stop


class _Signs:
    """Positions of signs in one paragraph, found once per sign."""

    def __init__(self, text: str, start: int, stop: int) -> None:
        self._text, self._start, self._stop, self._at = text, start, stop, {}

    def _positions(self, sign: str) -> list[int]:
        if sign not in self._at:
            self._at[sign] = [m.start() for m in re.compile(re.escape(sign)).finditer(self._text, self._start, self._stop)]
        return self._at[sign]

    def count(self, sign: str, before: int) -> int:
        return bisect_left(self._positions(sign), before)

    def last(self, sign: str, before: int) -> int:
        n = self.count(sign, before)
        return self._positions(sign)[n - 1] if n else -1


def _close(text: str, at: int, stop: int, signs: _Signs) -> int:
    """End of the closing quotes and brackets that begin at ``at``."""
    while at < stop:
        ch = text[at]
        if ch == "\n" and at + 1 < stop and text[at + 1] in "」』”）":
            at += 2
            continue
        if ch in " \u00a0\u202f\n" and at + 1 < stop and text[at + 1] == "»" and signs.last("«", at) > signs.last("»", at):
            at += 2
            continue
        if ch not in _CLOSING:
            break
        if ch == '"' and signs.count(ch, at) % 2 == 0:
            break
        if ch in _PAIRS and signs.last(_PAIRS[ch], at) <= signs.last(ch, at):
            break
        if ch in "*_'" and (at + 1 < stop and text[at + 1].isalnum()):
            break
        at += 1
    return at


def _mark(run: str) -> str:
    first = run[0]
    if first == ".":
        return "." if len(run) == 1 else "..."
    return "…" if first == "…" else first


@lru_cache(20_000)
def _class(ch: str) -> str:
    if ch.isdigit():
        return "digit"
    if ch.isalpha():
        return "upper" if ch.isupper() or ch.istitle() else "lower" if ch.islower() else "cjk" if re.match(f"[{_CJK}]", ch) else "letter"
    if ch in _OPENING or ch == "#":
        return "open"
    return "letter" if unicodedata.category(ch)[0] == "M" else "sign"


def last_token(text: str) -> str:
    """The token at the very end of ``text``, found backwards; empty if there is none."""
    found = _TOKEN.match(text[::-1])
    return found[0][::-1] if found else ""


class Signs(NamedTuple):
    """What decides a candidate, apart from the counters."""

    mark: str
    key: str
    wider: str
    next: str
    next_class: str
    gap: str
    closed: str
    shape: str


#: Between the fields of signs that are written as one text.
_FIELD = "\x1f"


class Candidate:
    """A possible boundary: ``end`` is the position behind its closing signs."""

    __slots__ = ("end", "mark", "key", "wider", "token", "closed", "gap", "start_of_next", "next", "next_class")

    def __init__(self, text: str, start: int, stop: int, match: re.Match, end: int) -> None:
        self.end, self.mark = end, _mark(match[0])
        before = text[max(start, match.start() - 48) : match.start()]
        self.token = last_token(before)
        if self.mark != ".":
            self.key = self.wider = self.mark
        else:
            self._key(before[: len(before) - len(self.token)].rstrip())
        self.closed = text[end - 1] if end > match.end() else ""
        if end < stop and text[end] == " " and not text[end + 1 : end + 2].isspace():
            self.start_of_next, self.gap = end + 1, "space"
        else:
            rest = _SPACE.match(text, end, stop)
            self.start_of_next, self.gap = (rest.end(), "space") if rest else (end, "none")
        self.look(text, self.start_of_next, stop)

    def _key(self, head: str) -> None:
        """The token with what stands before it, and a wider key for rare ones."""
        self.wider = f"D{min(len(self.token), 5)}" if self.token.isdigit() else f"{self.token}|"
        if self.token.isdigit():
            self.key = f"D{min(len(self.token), 5)}|{last_token(head.rstrip('.')) or head[-1:]}"
        else:
            kind = "dot" if head[-1:] == "." else "num" if head[-1:].isdigit() else "word"
            self.key = f"{self.token}|{kind}"

    @property
    def shape(self) -> str:
        return _shape(self.token)

    def signs(self) -> str:
        """The fields of :class:`Signs` as one text."""
        following = self.next if self.next != _FIELD else " "
        return _FIELD.join((self.mark, self.key, self.wider, following, self.next_class, self.gap, self.closed, _shape(self.token)))

    def look(self, text: str, at: int, stop: int) -> None:
        """Take what stands at ``at`` as the token behind."""
        self.next_class = _class(text[at]) if at < stop else "end"
        opened = at
        while at < stop and text[at] in _BEFORE_TOKEN:
            at += 1
        found = _TOKEN.match(text, at, min(stop, at + 48))
        self.next = found[0] if found else text[at : at + 1]
        if found and self.mark in "。！？｡" and text[found.end() : found.end() + 1] == "\n":  # a line break inside a text without spaces cuts words
            more = _TOKEN.match(text, found.end() + 1, min(stop, at + 48))
            self.next += more[0] if more and not _CHARACTER.match(more[0]) else ""
        if opened != at and at < stop and self.next_class == "open":
            self.next_class = "open-" + _class(text[at])


def candidates(text: str, start: int, stop: int) -> Iterator[Candidate]:
    signs = _Signs(text, start, stop)
    for match in _MARK.finditer(text, start, stop):
        first, end = text[match.start()], match.end()
        behind = text[end] if end < stop else ""
        if first in ".…" and (behind.islower() or behind.isdigit()):
            continue
        if first == "." and end == match.start() + 1:
            if behind and behind in "/\\@-_=&" and match.start() > start:
                continue
            if behind == "\n" and _BROKEN.match(text, max(start, end - 2), stop) and _CHARACTER.search(text, max(start, end - 25), min(stop, end + 24)):
                continue
        if behind and (text[end + 1 : end + 2] in _CLOSING_BEHIND if behind.isspace() else behind in _CLOSING):
            end = _close(text, end, stop, signs)
        yield Candidate(text, start, stop, match, end)


class Span(NamedTuple):
    """A paragraph with its candidates; code is one unit, whatever it holds."""

    start: int
    stop: int
    code: bool
    found: list[Candidate]


def scan(text: str, markdown: bool) -> list[Span]:
    """All paragraphs of a text with their candidates."""
    fenced = {m.start() + i for m in _FENCE.finditer(text) for i in range(8)} if markdown else set()
    return [Span(start, stop, start in fenced, list(candidates(text, start, stop))) for start, stop in paragraphs(text, markdown)]


class Statistics:
    """Hashed counters: marks after a token, of these at a paragraph's end; tokens, of these at its start."""

    def __init__(self, counts: np.ndarray | None = None) -> None:
        self.counts = np.zeros((4, SLOTS), np.int32) if counts is None else counts
        self._known: dict = {}
        self._pending = (Counter(), Counter(), Counter(), Counter())

    def add(self, text: str, markdown: bool) -> list[Span]:
        """Count a text; gives its scan."""
        found, spans = self._pending, scan(text, markdown)
        found[2].update(_TOKEN.findall(text))
        marks: list[str] = []
        ends: list[str] = []
        for start, stop, _, inside in spans:
            at = start
            while at < stop and (text[at] in _OPENING or text[at] in " #\u00a0\u3000"):
                at += 1
            first = _TOKEN.match(text, at, stop)
            if first:
                found[3][first[0]] += 1
            for c in inside:
                keys = (_ANY, c.key) if c.key == c.wider else (_ANY, c.key, c.wider)
                marks += keys
                if c.end >= stop:
                    ends += keys
        found[0].update(marks)
        found[1].update(ends)
        if len(found[2]) > 200_000:
            self.flush()
        return spans

    def flush(self) -> None:
        """Bring what was added into the counters."""
        self._known.clear()
        for row, counter in zip(self.counts, self._pending):
            if counter:
                n = np.fromiter(counter.values(), np.int32, len(counter))
                slots = np.array([_slots(token) for token in counter])
                np.add.at(row, slots[:, 0], n)
                np.add.at(row, slots[:, 1], n)
                counter.clear()

    def remembered(self, key: tuple, make: Callable[[], object]) -> object:
        """What ``make`` gives, once per ``key`` while the counters stay as they are."""
        if key not in self._known:
            if len(self._known) > 500_000:
                self._known.clear()
            self._known[key] = make()
        return self._known[key]

    def count(self, which: int, token: str) -> int:
        if self._pending[2]:
            self.flush()
        a, b = _slots(token)
        return int(min(self.counts[which, a], self.counts[which, b]))

    def base(self) -> float:
        """Share of all marks that end a paragraph: what an ordinary token's rate is held against."""
        return max(self.count(1, _ANY), 1) / max(self.count(0, _ANY), 1)

    def _bucket(self, part: int, whole: int, steps: tuple[float, ...]) -> str:
        """The band of the rate in units of the base rate; few occurrences keep a rate of none away from the lowest bands."""
        base = self.base()
        if whole * base < FREQUENT / 3:
            return "rare"
        rate = (part + 0.5) / (whole * base + 0.5)
        return str(sum(rate >= s for s in steps))

    def _key(self, c: Candidate) -> str:
        """The token with what stands before it, or alone where that is too rare."""
        return c.key if self.count(0, c.key) * self.base() >= NEVER_ENDS else c.wider

    def ends(self, c: Candidate, out: tuple[int, int] = (0, 0)) -> str:
        return self.remembered((c.key, c.wider, out), lambda: self._ends(c, out))

    def _ends(self, c: Candidate, out: tuple[int, int]) -> str:
        key = self._key(c)
        return self._bucket(self.count(1, key) - out[1], self.count(0, key) - out[0], (0.012, 0.09, 0.3, 0.6))

    def starts(self, c: Candidate, out: tuple[int, int] = (0, 0)) -> str:
        return self.remembered((c.next, out), lambda: self._starts(c, out))

    def _starts(self, c: Candidate, out: tuple[int, int]) -> str:
        return self._bucket(self.count(3, c.next) - out[1], self.count(2, c.next) - out[0], (0.006, 0.06, 0.18, 0.45))

    def never_ends(self, c: Candidate) -> bool:
        """Whether a mark follows this token often, but ends no paragraph there: an abbreviation, an ordinal."""
        key = self._key(c)
        expected = self.count(0, key) * self.base()
        return expected >= NEVER_ENDS and self.count(1, key) * 150 <= expected

    def never_starts(self, c: Candidate) -> bool:
        expected = self.count(2, c.next) * self.base()
        return expected >= NEVER_STARTS and self.count(3, c.next) * 300 <= expected


@lru_cache(200_000)
def _shape(token: str) -> str:
    if not token:
        return "none"
    if token.isdigit():
        return f"digits{min(len(token), 4)}"
    kind = _class(token[0])
    if any(ch.isdigit() for ch in token):
        kind += "+digit"
    elif len(token) > 1 and token.isupper():
        kind = "caps"
    return kind + str(min(len(token), 5))


def features(c: Candidate | Signs, ends: str, starts: str) -> list[str]:
    behind = c.next_class
    return [
        "bias", f"mark={c.mark}", f"ends={ends}", f"starts={starts}", f"next={behind}", f"gap={c.gap}|{behind}", f"ends={ends}|next={behind}",
        f"starts={starts}|next={behind}", f"ends={ends}|starts={starts}", f"shape={c.shape}", f"closed={c.closed}|next={behind}",
        f"closed={c.closed}|starts={starts}", f"mark={c.mark}|next={behind}", f"mark={c.mark}|gap={c.gap}", f"shape={c.shape}|ends={ends}",
    ]


#: Weights that hold until data say otherwise.
_PRIOR = {"bias": 1.0, "next=lower": -3.0, "next=sign": -4.0, "mark=...": -0.5, "gap=none|upper": -0.5, "ends=0": -2.0, "starts=0": -1.0}


@lru_cache(100_000)
def _feature(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & (WEIGHTS - 1)


def prior() -> np.ndarray:
    w = np.zeros(WEIGHTS)
    for name, value in _PRIOR.items():
        w[_feature(name)] += value
    return w


def label(c: Candidate, stats: Statistics) -> bool | None:
    """False for a reliable non-boundary inside a paragraph, else None."""
    if c.next_class == "sign" and c.next[:1] in ",;:،、，；":
        return False
    if stats.never_ends(c) or stats.never_starts(c):
        return False
    if c.next_class == "lower" and c.gap == "space" and stats.starts(c) in ("0", "1"):
        return False
    return None


def examples(text: str, markdown: bool, stats: Statistics) -> Iterator[tuple[bool, list[int]]]:
    """Labelled feature rows; every row's own counts are taken out of its statistics."""
    spans = scan(text, markdown)
    drawn = TRAIN_ROWS / max(TRAIN_ROWS, sum(len(s.found) for s in spans))
    for k, (start, stop, _, found) in enumerate(spans):
        if drawn < 1 and xxhash.xxh3_64_intdigest(text[start:stop]) / 2**64 >= drawn:
            continue
        for c in found:
            if c.end >= stop:
                if k + 1 == len(spans):
                    continue
                c.look(text, spans[k + 1].start, spans[k + 1].stop)
                closing = c.mark in "。！？｡"
                c.gap = "none" if closing or xxhash.xxh3_64_intdigest(f"{c.key} {c.next}") % 8 == 0 else "space"
                yield True, [_feature(f) for f in features(c, stats.ends(c, (1, 1)), stats.starts(c, (1, 1)))]
            else:
                known = label(c, stats)
                if known is not None:
                    yield known, [_feature(f) for f in features(c, stats.ends(c, (1, 0)), stats.starts(c, (1, 0)))]


def train(y: np.ndarray, x: np.ndarray, rounds: int = 200, pull: float = 0.5) -> np.ndarray:
    """Logistic weights by full-batch Adam, pulled towards the prior; a row of ``x`` has the places of a candidate's features."""
    base = prior()
    w, m, v = base.copy(), np.zeros(WEIGHTS), np.zeros(WEIGHTS)
    for step in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30))) - y
        gradient = np.bincount(x.ravel(), np.repeat(error, x.shape[1]), WEIGHTS) + pull * (w - base)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def ends_here(c: Candidate | Signs, stats: Statistics, weights: np.ndarray) -> bool:
    """The model's decision."""
    return bool(weights[[_feature(f) for f in features(c, stats.ends(c), stats.starts(c))]].sum() > 0)


def boundaries(text: str, markdown: bool, stats: Statistics, weights: np.ndarray) -> list[tuple[int, int]]:
    """Sentences of ``text`` as start and end."""
    out = []
    for start, stop, code, found in scan(text, markdown):
        at = start
        for c in [] if code else found:
            if at < c.end < stop and ends_here(c, stats, weights):
                out.append((at, c.end))
                at = c.start_of_next
        if at < stop:
            out.append((at, stop))
    return out


def _rows(docs: DataFrame, key: str, text: str, blocks: Column, wanted: Column) -> DataFrame:
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(blocks, F.lit(False)).alias("md"), wanted.alias("wanted")
    )


#: One row per document (its paragraphs as start, stop and number of candidates; places and signs of these), and some rows of counters per task.
_SCAN = "paragraphs array<int>, ends array<int>, nexts array<int>, signs array<string>, slot array<long>, n array<long>"


def scanned(rows: DataFrame, with_text: bool) -> DataFrame:
    """What one pass over the texts gives (``_SCAN``, with key ``k`` and text ``t`` on demand); candidates of documents that are not ``wanted`` are only counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats, seen = Statistics(), 0
        for batch in batches:
            made = []
            for name, whole, md, wanted in zip(batch["k"], batch["t"], batch["md"], batch["wanted"]):
                spans = stats.add(whole, md)
                seen += 1
                if wanted:
                    inside = [[c for c in s.found if c.end < s.stop] if not s.code else [] for s in spans]
                    flat = [c for found in inside for c in found]
                    made.append((
                        name, whole if with_text else None, [x for s, found in zip(spans, inside) for x in (s.start, s.stop, len(found))],
                        [c.end for c in flat], [c.start_of_next for c in flat], [c.signs() for c in flat], None, None,
                    ))
            yield pd.DataFrame(made, columns=names)
        stats.flush()
        yield pd.DataFrame([(None,) * 6 + ([-1], [seen])], columns=names)
        for which, row in enumerate(stats.counts):
            slot = np.flatnonzero(row)
            yield pd.DataFrame([(None,) * 6 + (slot + which * SLOTS, row[slot])], columns=names)

    names = ["k", "t", *[f.split()[0] for f in _SCAN.split(", ")]]
    return materialize(spread(rows).mapInPandas(run, f"k {dict(rows.dtypes)['k']}, t string, {_SCAN}"), "scanned")


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A block of counters as bytes; block -1 has the number of documents."""
    block = int(rows["slot"].iloc[0] // PACKED)
    if block < 0:
        return pd.DataFrame({"block": [block], "data": [np.int64(rows["n"].iloc[0]).tobytes()]})
    data = np.zeros(PACKED, np.int32)
    data[rows["slot"].to_numpy(np.int64) - block * PACKED] = np.minimum(rows["n"].to_numpy(np.int64), 2**31 - 1)
    return pd.DataFrame({"block": [block], "data": [data.tobytes()]})


def learn(rows: DataFrame, found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counters over all documents ``rows`` (k, t, md), scanned to ``found``, and the weights trained on reliable boundaries."""
    counted = found.where("slot is not null").select(F.explode(F.arrays_zip("slot", "n")).alias("x")).groupBy("x.slot").agg(F.sum("x.n").alias("n"))
    blocks = counted.groupBy(F.floor(F.col("slot") / PACKED).alias("block")).applyInPandas(_packed, "block long, data binary").collect()
    counts, total = np.zeros(4 * SLOTS, np.int32), 0
    for r in blocks:
        if r["block"] < 0:
            total = int(np.frombuffer(r["data"], np.int64)[0])
        else:
            counts[r["block"] * PACKED : (r["block"] + 1) * PACKED] = np.frombuffer(r["data"], np.int32)
    counts = counts.reshape(4, SLOTS)
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = Statistics(shared.value)
        for batch in batches:
            found = [e for whole, md in zip(batch["t"], batch["md"]) for e in examples(whole, md, stats)]
            if found:
                y, x = np.array([f[0] for f in found], np.int32), np.array([f[1] for f in found], np.int32)
                yield pd.DataFrame({"width": [x.shape[1] + 1], "data": [np.column_stack((y, x)).tobytes()]})

    drawn = rows.where(F.pmod(F.xxhash64("k", F.lit("train")), F.lit(max(total, 1))) < TRAIN_DOCUMENTS)
    labelled = [np.frombuffer(r["data"], np.int32).reshape(-1, r["width"]) for r in drawn.mapInPandas(extract, "width int, data binary").collect()]
    if not labelled:
        return counts, prior()
    table = np.concatenate(labelled)
    table = table[np.lexsort(table.T[::-1])]  # the order of the partitions must not matter
    return counts, train(table[:, 0], table[:, 1:])


def sentences(docs: DataFrame, key: str, text: str = "text", blocks: Column | None = None, only: Column | None = None, with_text: bool = True) -> DataFrame:
    """``key, sentence_no, start_char, end_char`` and ``sentence`` for every sentence of every document.

    ``blocks`` says which documents are Markdown; none by default. The model learns from all
    documents; with ``only``, sentences of the documents where it holds come out.
    """
    wanted = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    rows = _rows(docs.withColumn("__wanted", wanted), key, text, F.lit(False) if blocks is None else blocks, F.col("__wanted"))
    found = scanned(rows, with_text)
    shared = docs.sparkSession.sparkContext.broadcast(learn(rows, found))
    names = ["key", "sentence_no", "start_char", "end_char", *["sentence"] * with_text]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, weights = shared.value
        stats, known = Statistics(counts), {}
        for batch in batches:
            if not len(batch):
                continue
            if len(known) > 500_000:
                known.clear()
            codes, signs = pd.factorize(np.concatenate(batch["signs"].to_numpy()))
            for one in signs:
                if one not in known:
                    known[one] = ends_here(Signs(*one.split(_FIELD)), stats, weights)
            here = np.array([known[one] for one in signs], bool)[codes].tolist() if len(signs) else []
            made, done = [], 0
            for name, whole, spans, ends, nexts in zip(batch["k"], batch["t"], batch["paragraphs"], batch["ends"], batch["nexts"]):
                spans, ends, nexts, base, number = spans.tolist(), ends.tolist(), nexts.tolist(), done, 0
                for start, stop, n in zip(spans[::3], spans[1::3], spans[2::3]):
                    at = start
                    for i in range(done - base, done - base + n):
                        if here[base + i] and ends[i] > at:
                            number += 1
                            made.append((name, number, at, ends[i], whole and whole[at : ends[i]])[: len(names)])
                            at = nexts[i]
                    done += n
                    if at < stop:
                        number += 1
                        made.append((name, number, at, stop, whole and whole[at:stop])[: len(names)])
            yield pd.DataFrame(made, columns=names)

    schema = f"key {dict(docs.dtypes)[key]}, sentence_no int, start_char int, end_char int" + ", sentence string" * with_text
    picked = found.where("paragraphs is not null").select("k", "t", "paragraphs", "ends", "nexts", "signs")
    return picked.mapInPandas(cut, schema).withColumnRenamed("key", key)
