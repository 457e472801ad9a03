"""Markup residue in text documents: union-free wrappers inferred from same-host token streams.

A text is cut into blocks; a block with HTML, wiki or LaTeX tokens outside of code is a token stream
(tags, wiki marks, commands and text slots ``#``). Streams of the same host, kind and first token
are aligned one after another: where two of them differ, a repeated part becomes a repeated group
``+`` and anything else an optional group ``?``; text is a slot. What results is a union-free regular
expression, the wrapper of those blocks. Blocks are then read through their wrapper: its repeated
groups give list items and table rows where the tokens' own meaning does not, and headings, lists,
tables, code and formulas are kept as Markdown.

Fenced code, inline code and Windows paths are opaque; Markdown, ``[[note]]`` links, comparisons,
prices and shell variables carry no token. Null and empty texts have no residue and stay as they
are. Repeated rows of a key count once. A null host is a host of its own. Equal streams are counted
before they move, streams of one host are folded in runs by their frequency first, so neither a hot host nor a
hot stream ends up in one Python task (a host's distinct streams are sorted in one of the JVM).
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mneme.storage import materialize, spread

#: What a text must hold for any token to be possible; checked in the JVM.
TRIGGER = r"<[A-Za-z/!]|&[A-Za-z#]|''|(?m:^={2,6})|\{\{|\{\||__[A-Z]|\[\[[^\]|]*:|\\|\$"
#: Streams that one task folds; depth to which nested elements are looked into (deeper ones stay as they are).
FOLD, DEEPEST = 2000, 60

# fixed values: the elements of HTML
_TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas "
    "caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption "
    "figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label "
    "legend li link main map mark marquee math menu meta meter nav nobr noframes noscript object ol optgroup option output p "
    "param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary "
    "sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
# fixed values: magic words and link prefixes of MediaWiki in the vault's languages
_MAGIC = (
    "TOC NOTOC FORCETOC NOEDITSECTION NEWSECTIONLINK NONEWSECTIONLINK NOGALLERY HIDDENCAT EXPECTUNUSEDCATEGORY NOCONTENTCONVERT "
    "NOCC NOTITLECONVERT NOTC START END INDEX NOINDEX STATICREDIRECT DISAMBIG INHALTSVERZEICHNIS KEIN_INHALTSVERZEICHNIS "
    "INHALTSVERZEICHNIS_ERZWINGEN SOMMAIRE AUCUNSOMMAIRE TDC NOTDC"
).split()
_PREFIXES = (
    "file image media category datei bild kategorie fichier catégorie archivo imagen categoría 文件 图像 图片 分类 ファイル 画像 カテゴリ ملف صورة تصنيف चित्र श्रेणी"
).split()
# fixed values: LaTeX commands that stand without an argument
_BARE = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi "
    "varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega le leq ge geq ne neq approx equiv sim cdot "
    "times div pm mp to rightarrow leftarrow Rightarrow Leftarrow infty partial nabla sum prod int oint forall exists in notin "
    "subset subseteq cup cap land lor neg ldots cdots dots quad qquad item hline noindent newpage clearpage maketitle "
    "tableofcontents bigskip medskip smallskip par centering bfseries itshape ttfamily LaTeX TeX left right limits"
).split()

_FENCE = re.compile(r"^[ \t>]*(`{3,}|~{3,})[^\n]*(?:\n(?:(?![ \t>]*\1)[^\n]*(?:\n|\Z))*(?:[ \t>]*\1[`~]*[ \t]*(?=\r?$|\Z))?)?", re.M)
_INLINE = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t]*\r?\n).)+?)(?<!`)\1(?!`)", re.S)
_HTML_CODE = re.compile(r"(<(pre|code|script|style|nowiki|math)\b[^<>]*>)(.*?)(</\2\s*>)", re.S | re.I)
_PATH = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]:\\[^\s<>|\"]*|(?<![\w\\])\\\\[\w.$-]+\\[^\s<>|\"]*")

_ATTRIBUTES = r"(?:\s+[A-Za-z_:@][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*"
_TOKENS = re.compile(
    "|".join(
        (
            r"(?P<comment><!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>)",
            rf"(?P<tag></?(?P<name>{'|'.join(sorted(_TAGS, key=len, reverse=True))})(?![\w-]){_ATTRIBUTES}\s*/?>)",
            r"(?P<entity>&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)",
            r"(?P<wquote>(?<!')(?P<q>'{5}|'{2,3})(?![\s'])(?P<quoted>(?:(?!\n)(?!'').|(?<!')'{2}(?=[^'\n]+'{2})[^'\n]+'{2})+?)(?<!\s)(?P=q)(?!'))",
            r"(?P<whead>^(?P<h>={2,6})(?:(?<=={3})|(?=[^\n]*\s))[ \t]*(?P<htext>[^=\s][^\n]*?)[ \t]*(?P=h)[ \t]*(?=\r?$))",
            r"(?P<wtemplate>\{\{\s*[#:]?[^\W\d_](?:[^{}|\n]|(?<=\S)\n)*(?:\|(?:[^{}]|\{\{[^{}]*\}\})*)?\}\})",
            r"(?P<wtable>^[ \t:]*\{\|[^\n]*\n.*?^[ \t]*\|\}|^[ \t:]*\{\|)",
            rf"(?P<wlink>\[\[\s*:?(?i:{'|'.join(_PREFIXES)})\s*:[^\[\]]+(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\])",
            rf"(?P<wmagic>__(?:{'|'.join(_MAGIC)})__)",
            r"(?P<lenv>\\(?P<be>begin|end)\s*\{(?P<env>[A-Za-z]+\*?)\})",
            r"(?P<ldisplay>\$\$(?=[^$]*[^$\s])[^$]+\$\$|\\\[(?=(?:(?!\\\]).)*[\\^_=+*/<>0-9])(?:(?!\\\]).)+\\\])",
            r"(?P<linline>\\\((?:(?!\\\)|\n\s*\n).)+\\\)|(?<![\\\w$])\$(?=[^\s$])(?:(?=[^$\n]*[\\^_{}=])[^$\n]*|[A-Za-z](?:')?|[A-Za-z0-9]+[ ]?[+*/<>-][ ]?[A-Za-z0-9]+)(?<![\s\\])\$(?![\w$]))",
            r"(?P<lcommand>(?<![\\:/])\\(?P<cmd>[A-Za-z]{2,})\*?(?:\[[^\[\]\n]*\])?\{(?P<arg>(?:[^{}]|\{[^{}]*\})*)\})",
            rf"(?P<lbare>(?<![\w\\:/])\\(?:{'|'.join(_BARE)})(?![A-Za-z\\]))",
        )
    ),
    re.S | re.M | re.I,
)
_TOKENS = re.compile(_TOKENS.pattern.replace("__(?:", "(?-i:__)(?-i:"), re.S | re.M | re.I)
_OPEN = {"comment": "html", "tag": "html", "entity": "html"}


def _kind(group: str) -> str:
    return _OPEN.get(group) or ("wiki" if group[0] == "w" else "latex")


class Token:
    __slots__ = ("kind", "group", "start", "end", "match")

    def __init__(self, match: re.Match, shift: int = 0) -> None:
        self.group = next(g for g in _GROUPS if match[g] is not None)
        self.kind, self.match = _kind(self.group), match
        self.start, self.end = match.start() + shift, match.end() + shift

    def label(self) -> str:
        m = self.match
        if self.group == "tag":
            return ("</" if m["tag"][1] == "/" else "<") + m["name"].lower() + ">"
        if self.group == "lenv":
            return f"\\{m['be']}{{{m['env']}}}"
        if self.group == "lcommand":
            return "\\" + m["cmd"] + "{}"
        if self.group == "lbare":
            return m["lbare"]
        if self.group == "wquote":
            return m["q"] + "#" + m["q"]
        if self.group == "whead":
            return m["h"] + "#" + m["h"]
        return "<" + self.group + ">"


_GROUPS = ("comment", "tag", "entity", "wquote", "whead", "wtemplate", "wtable", "wlink", "wmagic", "lenv", "ldisplay", "linline", "lcommand", "lbare")


def opaque_spans(text: str) -> list[tuple[int, int]]:
    """Code and paths, sorted, without overlaps: nothing in them is markup."""
    spans = [m.span() for m in _FENCE.finditer(text)]
    rest = _blank(text, spans)
    spans += [m.span() for m in _INLINE.finditer(rest)]
    rest = _blank(text, spans)
    spans += [(m.start(3), m.end(3)) for m in _HTML_CODE.finditer(rest) if m.end(3) > m.start(3)]
    spans += [m.span() for m in _PATH.finditer(_blank(text, spans))]
    return sorted(spans)


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the characters of ``spans`` replaced, line breaks kept, positions unchanged."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], re.sub(r"[^\n]", "\x00", text[a:b])]
            at = b
    return "".join(out) + text[at:]


def tokens(text: str) -> list[Token]:
    """Markup tokens of ``text`` outside of code."""
    found = []
    for m in _TOKENS.finditer(_blank(text, opaque_spans(text))):
        if m["entity"] is not None and m["entity"][1] != "#" and m["entity"][1:] not in html5:
            continue
        found.append(Token(m))
    return found


def streams(text: str) -> list[tuple[int, str, list[str]]]:
    """Per block with markup and per kind in it: block number, kind and the token stream."""
    found = tokens(text)
    if not found:
        return []
    borders = [m.end() for m in re.finditer(r"\n[ \t]*\r?\n", text)] + [len(text) + 1]
    out: list[tuple[int, str, list[str]]] = []
    block, by_kind, last = 0, {}, {}
    for token in found:
        while token.start >= borders[block]:
            out += [(block, k, s) for k, s in by_kind.items()]
            block, by_kind, last = block + 1, {}, {}
        stream = by_kind.setdefault(token.kind, [])
        if token.kind in last and text[last[token.kind] : token.start].strip():
            stream.append("#")
        stream.append(token.label())
        last[token.kind] = token.end
    return out + [(block, k, s) for k, s in by_kind.items()]


# A wrapper is a list of items: a token, ["+", [items]] or ["?", [items]].


def _tandem(items: list) -> list:
    """Equal neighbours become repeated groups, the shortest repeats first."""
    width = 1
    while width <= len(items) // 2:
        at, out, found = 0, [], False
        while at < len(items):
            unit, end = items[at : at + width], at + width
            while len(unit) == width and items[end : end + width] == unit:
                end += width
            if end > at + width:
                found = True
                out.append(unit[0] if width == 1 and isinstance(unit[0], list) else ["+", unit])
                at = end
            else:
                out.append(items[at])
                at += 1
        items, width = out, width if found else width + 1
        if found and width == 1:
            width = 2
    return items


def _unit_end(items: list, at: int) -> int:
    """Index of the closing tag of the opening tag at ``at``; -1 where there is none."""
    opening = items[at]
    if not isinstance(opening, str) or opening[0] != "<" or opening[1] == "/":
        return -1
    closing, depth = "</" + opening[1:], 0
    for i in range(at, len(items)):
        depth += (items[i] == opening) - (items[i] == closing)
        if depth == 0:
            return i
    return -1


def collapse(items: list, depth: int = 0) -> list:
    """Repeats become repeated groups: neighbouring elements of one tag, aligned with each other, and equal neighbours."""
    out, at = [], 0
    while at < len(items) and depth < DEEPEST:
        end = _unit_end(items, at)
        if end < 0:
            out.append(items[at])
            at += 1
            continue
        units = []
        while end >= 0:
            units.append([items[at], *collapse(items[at + 1 : end], depth + 1), items[end]])
            follows = end + 1 < len(items) and items[end + 1] == items[at]
            at = end + 1
            end = _unit_end(items, at) if follows else -1
        inner = units[0]
        for unit in units[1:]:
            inner = align(inner, unit)
        out += [["+", inner]] if len(units) > 1 else inner
    return _tandem(out if depth < DEEPEST else list(items))


def _key(item: str | list) -> str:
    """What two items must share to be the same place of a wrapper: an optional place is its content's."""
    if isinstance(item, str):
        return item
    return ("+" if item[0] == "+" else "") + _key(item[1][0])


def _merge(x: str | list, y: str | list) -> str | list:
    """One item for two of the same key."""
    if isinstance(x, str) and isinstance(y, str):
        return x
    if isinstance(x, list) and x[0] == "?" or isinstance(y, list) and y[0] == "?":
        bare = lambda i: i[1][0] if isinstance(i, list) and i[0] == "?" else i
        return ["?", [_merge(bare(x), bare(y))]]
    return ["+", align(x[1], y[1])]


def _lift(items: list, repeated: set[str]) -> list:
    """Single elements whose tag is repeated elsewhere as groups of one; groups that meet are one."""
    out: list = []
    at = 0
    while at < len(items):
        end = _unit_end(items, at) if isinstance(items[at], str) and items[at] in repeated else -1
        item = ["+", items[at : end + 1]] if end >= 0 else items[at]
        at = max(at, end) + 1
        if out and isinstance(item, list) and item[0] == "+" and isinstance(out[-1], list) and out[-1][0] == "+" and _key(out[-1]) == _key(item):
            out[-1] = _merge(out[-1], item)
        else:
            out.append(item)
    return out


def _maybe(item: str | list) -> list:
    return item if isinstance(item, list) and item[0] == "?" else ["?", [item]]


def _longest(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the longest run in both; of several the first in ``a``, then in ``b``.

    The longer list is read through the suffix automaton of the shorter one: ``steps``, suffix link, length and first end per state.
    """
    short, long = (a, b) if len(a) < len(b) else (b, a)
    steps: list[dict[str, int]] = [{}]
    link, length, first, last = [-1], [0], [-1], 0
    for at, key in enumerate(short):
        state, new = last, len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(at)
        while state >= 0 and key not in steps[state]:
            steps[state][key] = new
            state = link[state]
        if state >= 0:
            to = steps[state][key]
            if length[to] > length[state] + 1:
                copy = len(steps)
                steps.append(dict(steps[to]))
                link.append(link[to])
                length.append(length[state] + 1)
                first.append(first[to])
                while state >= 0 and steps[state].get(key) == to:
                    steps[state][key] = copy
                    state = link[state]
                link[to] = copy
                to = copy
            link[new] = to
        last = new
    state, size, best = 0, 0, (0, 0, 0)
    for at, key in enumerate(long):
        while state and key not in steps[state]:
            state = link[state]
            size = length[state]
        if key in steps[state]:
            state, size = steps[state][key], size + 1
            ends = (at, first[state]) if long is a else (first[state], at)
            best = min(best, (-size, ends[0] + 1 - size, ends[1] + 1 - size))
    return best[1], best[2], -best[0]


def _shared(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Runs that both have, in order: the longest, then the same before and behind it. The same as difflib's matching blocks, which take it quadratic time per run."""
    found, left = [], [(0, len(a), 0, len(b))]
    while left:
        a0, a1, b0, b1 = left.pop()
        i, j, n = _longest(a[a0:a1], b[b0:b1])
        if n:
            i, j = a0 + i, b0 + j
            found.append((i, j, n))
            left += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    return sorted(found)


def align(wrapper: list, sample: list) -> list:
    """A union-free wrapper that reads what either of the two reads."""
    if wrapper == sample:
        return wrapper
    repeated = {_key(i)[1:] for i in [*wrapper, *sample] if isinstance(i, list) and _key(i)[0] == "+"}
    if wrapper and sample and wrapper[0] == sample[0] and _unit_end(wrapper, 0) == len(wrapper) - 1 and _unit_end(sample, 0) == len(sample) - 1:
        repeated.discard(wrapper[0])  # one element each: as groups of one they would be aligned again, without end
    a, b = (_lift(x, repeated) for x in (wrapper, sample))
    out: list = []
    a0 = b0 = 0
    for i, j, n in [*_shared(list(map(_key, a)), list(map(_key, b))), (len(a), len(b), 0)]:
        out += [*map(_maybe, a[a0:i]), *map(_maybe, b[b0:j])]
        out += [_merge(x, y) for x, y in zip(a[i : i + n], b[j : j + n])]
        a0, b0 = i + n, j + n
    return out


def reads(wrapper: list, stream: list[str]) -> bool:
    """Whether ``wrapper`` matches the whole ``stream``: all positions it can have reached are followed at once."""

    def advance(items: list, at: set[int]) -> set[int]:
        for item in items:
            if isinstance(item, str):
                at = {i + 1 for i in at if i < len(stream) and stream[i] == item}
            elif item[0] == "?":
                at = at | advance(item[1], at)
            else:
                fresh = advance(item[1], at)
                at = set(fresh)
                while fresh:
                    fresh = advance(item[1], fresh) - at
                    at |= fresh
            if not at:
                break
        return at

    return len(stream) in advance(wrapper, {0})


def infer(samples: list[list]) -> list:
    """The wrapper of all ``samples`` (streams or wrappers), in the order given."""
    wrapper: list = []
    for k, sample in enumerate(samples):
        shape = collapse(sample)
        wrapper = shape if k == 0 else align(wrapper, shape)
    return wrapper


def block_streams(texts: DataFrame, key: str, host: str, text: str = "text") -> DataFrame:
    """``key, host, block, kind, anchor, stream`` (stream as JSON) of every block with markup."""
    kind_of_key, kind_of_host = dict(texts.dtypes)[key], dict(texts.dtypes)[host]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, h, block, kind, stream[0], json.dumps(stream, ensure_ascii=False))
                for k, h, t in zip(batch["key"], batch["host"], batch["text"])
                for block, kind, stream in streams(t)
            ]
            yield pd.DataFrame(rows, columns=["key", "host", "block", "kind", "anchor", "stream"])

    rows = texts.where(F.col(text).rlike(TRIGGER)).select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    schema = f"key {kind_of_key}, host {kind_of_host}, block int, kind string, anchor string, stream string"
    return materialize(spread(rows).mapInPandas(find, schema), "streams")


def wrappers(found: DataFrame) -> DataFrame:
    """``host, kind, anchor, wrapper, n_streams`` (wrapper as JSON) from block streams.

    The streams of a host, kind and first token are folded from the most frequent one on, in runs of ``FOLD``, then runs of ``FOLD`` runs,
    then what is left: a wrapper depends on its own streams only, not on how many the input has.
    """
    hosts = dict(found.dtypes)["host"]
    group = ["host", "kind", "anchor"]
    names = [*group, "place", "stream", "wrapper", "n"]
    schema = f"host {hosts}, kind string, anchor string, place long, stream string, wrapper string, n long"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")[names]
        first = rows.head(1)
        if first["wrapper"].iloc[0] is None:
            wrapper = infer([json.loads(s) for s in rows["stream"]])
        elif len(rows) > 1:
            wrapper = reduce(align, map(json.loads, rows["wrapper"]))
        else:
            return first
        return first.assign(stream=None, wrapper=json.dumps(wrapper, ensure_ascii=False), n=rows["n"].sum())

    distinct = found.groupBy(*group, "stream").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "stream")) - F.lit(1).cast("long")
    parts = distinct.select(*group, place.alias("place"), "stream", F.lit(None).cast("string").alias("wrapper"), "n")
    for run in (f"place div {FOLD}", f"place div {FOLD * FOLD}", "0"):
        parts = parts.groupBy(*group, F.expr(run).alias("run")).applyInPandas(fold, schema)
    return parts.select(*group, "wrapper", F.col("n").alias("n_streams"))


def residue(texts: DataFrame, key: str, host: str, text: str = "text") -> DataFrame:
    """Blocks with markup read through their wrappers: ``key, host, block, kind, stream, wrapper, matched``."""
    found = block_streams(texts, key, host, text)
    learned = materialize(wrappers(found).drop("n_streams"), "wrappers")
    joined = found.withColumn("h", F.coalesce(F.col("host").cast("string"), F.lit("\0"))).join(
        learned.withColumn("h", F.coalesce(F.col("host").cast("string"), F.lit("\0"))).drop("host"), ["h", "kind", "anchor"], "left"
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], bool] = {}
        for batch in batches:
            yield batch.assign(matched=[
                known[p] if p in known else known.setdefault(p, reads(json.loads(p[0]), json.loads(p[1])))
                for p in zip(batch["wrapper"], batch["stream"])
            ])

    names = ["key", "host", "block", "kind", "stream", "wrapper"]
    kinds = dict(joined.dtypes)
    return joined.select(*names).mapInPandas(read, ", ".join(f"{n} {kinds[n]}" for n in names) + ", matched boolean")


# ---- clean text


def _repeated_opening(wrapper: list) -> set[str]:
    out: set[str] = set()
    for item in wrapper:
        if isinstance(item, list):
            if item[0] == "+" and isinstance(item[1][0], str) and "#" in item[1]:
                out.add(item[1][0])
            out |= _repeated_opening(item[1])
    return out


#: A code element inside of a preformatted one, as it stands once the outer one is a fence.
_PRE_CODE = re.compile(r"```\n\s*<code[^<>]*>(.*?)</code\s*>\s*\n```", re.S | re.I)
_BLOCK_TAGS = {"p", "div", "section", "article", "table", "ul", "ol", "dl", "blockquote", "center", "header", "footer", "form", "figure"}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}
_SCRIPTS = {"sup": "^", "sub": "_"}
# fixed values: LaTeX commands and the Markdown they stand for
_COMMANDS = {"textbf": "**", "emph": "*", "textit": "*", "texttt": "`", "underline": "", "text": "", "textsc": ""}
_HEADINGS = {"part": "#", "chapter": "#", "section": "##", "subsection": "###", "subsubsection": "####", "paragraph": "#####"}


def _wiki_table(source: str) -> str:
    rows: list[list[str]] = [[]]
    for line in source.split("\n")[1:]:
        line = line.strip()
        if line.startswith(("|}", "|+")):
            continue
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in "!|" and line:
            cells = re.split(r"!!|\|\|", line[1:])
            rows[-1] += [c.rpartition("|")[2].strip() if not c.startswith("[[") else c.strip() for c in cells]
        elif rows[-1] and line:
            rows[-1][-1] += " " + line
    rows = [r for r in rows if r]
    if not rows:
        return ""
    head, body = rows[0], rows[1:]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in body)])


def clean(text: str, learned: list[list] = ()) -> str:
    """``text`` as clean Markdown; code is kept as it is."""
    found = tokens(text)
    if not found:
        return text
    repeated = set().union(*map(_repeated_opening, learned)) if learned else set()
    out: list[str] = []
    at, lists, in_code, cells = 0, [], False, 0
    for token in found:
        if token.start < at:
            continue
        before = text[at : token.start]
        if token.group == "lcommand" and before.endswith("~"):  # LaTeX's blank that doesn't break
            before = before[:-1] + " "
        out.append(before)
        at, m, whole = token.end, token.match, text[token.start : token.end]
        group = token.group
        if group == "tag":
            name, closing = m["name"].lower(), whole[1] == "/"
            if name == "pre":
                out.append("\n```\n" if not closing else "\n```\n")
                in_code = not closing
            elif name == "code":
                out.append("" if in_code else "`")
            elif name == "br":
                out.append("\n")
            elif name == "hr":
                out.append("\n---\n")
            elif re.fullmatch("h[1-6]", name):
                out.append("\n" if closing else "\n" + "#" * int(name[1]) + " ")
            elif name in ("ul", "ol"):
                lists = lists[:-1] if closing else [*lists, [name, 0]]
                out.append("\n")
            elif name == "li" or (f"<{name}>" in repeated and name in ("div", "span", "p", "dd") and not closing and len(repeated) == 1):
                if not closing:
                    if lists:
                        lists[-1][1] += 1
                    fresh = "" if "".join(out[-3:]).rstrip(" \t").endswith("\n") else "\n"
                    out.append(fresh + "  " * max(0, len(lists) - 1) + (f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "))
            elif name == "tr":
                out.append(" |\n" if cells else "" if closing else "\n")
                cells = 0
            elif name in ("td", "th"):
                if not closing:
                    out.append("| " if not cells else " | ")
                    cells += 1
            elif name in _MARKS:
                out.append(_MARKS[name])
            elif name in _SCRIPTS:
                out.append("" if closing else _SCRIPTS[name])
            elif name == "img":
                alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", whole, re.I)
                out.append((alt[1] or alt[2] or "") if alt else "")
            elif name in _BLOCK_TAGS:
                out.append(" |\n" if name == "table" and closing and cells else "\n")
                cells = 0 if name == "table" else cells
        elif group == "entity":
            out.append(html.unescape(whole).replace("\xa0", " "))
        elif group == "wquote":
            mark = {2: "*", 3: "**", 5: "***"}[len(m["q"])]
            out.append(mark + text[m.start("quoted") : m.end("quoted")].replace("''", "") + mark)
        elif group == "whead":
            out.append("#" * len(m["h"]) + " " + text[m.start("htext") : m.end("htext")])
        elif group == "wtable":
            out.append(_wiki_table(whole))
        elif group == "wtemplate":
            parts = [p.strip() for p in whole[2:-2].split("|")]
            out.append(", ".join(p for p in parts[1:] if p and "=" not in p))
        elif group == "wlink":
            caption = whole[2:-2].split("|")
            out.append(caption[-1].strip() if len(caption) > 1 and "=" not in caption[-1] else "")
        elif group == "lenv":
            env, begin = m["env"].rstrip("*"), m["be"] == "begin"
            if env in ("itemize", "enumerate", "description"):
                lists = [*lists, ["ol" if env == "enumerate" else "ul", 0]] if begin else lists[:-1]
            elif env in ("verbatim", "lstlisting", "minted"):
                out.append("```")
            elif env in ("equation", "align", "gather", "multline", "displaymath", "eqnarray", "math"):
                out.append("$$")
        elif group == "ldisplay":
            out.append(whole if whole.startswith("$$") else "$$" + whole[2:-2].strip() + "$$")
        elif group == "linline":
            out.append(whole if whole.startswith("$") else "$" + whole[2:-2].strip() + "$")
        elif group == "lcommand":
            cmd, arg = m["cmd"], text[m.start("arg") : m.end("arg")]
            if cmd in _HEADINGS:
                out.append(_HEADINGS[cmd] + " " + arg)
            elif cmd in _COMMANDS:
                out.append(_COMMANDS[cmd] + arg + _COMMANDS[cmd])
            elif cmd in ("footnote", "caption", "title", "author"):
                out.append(f" ({arg})" if cmd == "footnote" else arg)
            elif cmd in ("cite", "ref", "eqref", "pageref"):
                out.append(f"[{arg}]")
            elif cmd in ("frac", "sqrt", "sum", "mathbb", "mathrm", "vec", "hat"):
                out.append(whole)
            elif cmd not in ("label", "vspace", "hspace", "usepackage", "documentclass", "includegraphics", "input"):
                out.append(arg)
        elif group == "lbare":
            if whole == "\\item":
                if lists:
                    lists[-1][1] += 1
                out.append(f"{lists[-1][1]}." if lists and lists[-1][0] == "ol" else "-")
            elif whole.lstrip("\\") not in ("noindent", "newpage", "clearpage", "maketitle", "tableofcontents", "bigskip", "medskip", "smallskip", "centering", "par"):
                out.append(whole)
    out.append(text[at:])
    joined = _PRE_CODE.sub(lambda m: f"```\n{html.unescape(m[1]).strip(chr(10))}\n```", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", joined).strip("\n")


def clean_texts(texts: DataFrame, key: str, host: str, text: str = "text") -> DataFrame:
    """``key, text, clean, kinds`` of every text, each key once; texts without markup stay as they are."""
    kind_of_key = dict(texts.dtypes)[key]
    single = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    suspicious = materialize(single.where(F.col("text").rlike(TRIGGER)).dropDuplicates(["key"]), "suspicious")
    read = residue(suspicious, "key", "host", "text")
    learned = read.groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), F.collect_set("wrapper").alias("wrappers"))
    joined = suspicious.select("key", "text").join(learned, "key")

    def cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["clean"] = [clean(t, [json.loads(w) for w in ws]) for t, ws in zip(batch["text"], batch["wrappers"])]
            yield batch[["key", "text", "clean", "kinds"]]

    marked = joined.mapInPandas(cleaned, f"key {kind_of_key}, text string, clean string, kinds array<string>")
    rest = single.dropDuplicates(["key"]).select("key", "text").join(learned.select("key"), "key", "left_anti")
    plain = rest.select("key", "text", F.col("text").alias("clean"), F.array().cast("array<string>").alias("kinds"))
    return marked.unionByName(plain).withColumnRenamed("key", key)
