"""Text expressions: Column in, Column out, no Python in the data path.

Nulls give nulls unless said otherwise. Patterns use Unicode white space like Python's ``\\s`` and
treat only line feeds as line ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"(?U)\s+"
_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, _ENDS, "")


def collapse(c: Column) -> Column:
    """Every run of white space as one blank; ends are kept."""
    return F.regexp_replace(c, _WHITE, " ")


def normalize_query(c: Column) -> Column:
    """Lower case, single blanks, trimmed: the key under which results are cached."""
    return strip(collapse(F.lower(c)))


def sanitize(c: Column, longest: int = 2000) -> Column:
    """Cut to ``longest`` characters, with the prompt's section marks made harmless."""
    return F.replace(F.replace(F.substring(c, 1, longest), F.lit("=== "), F.lit("~~~ ")), F.lit("---"), F.lit("–––"))


def uuid_of(c: Column) -> Column:
    """The first 128 bits of the text's SHA-256 in the form of a UUID."""
    return F.regexp_replace(
        F.substring(F.sha2(c, 256), 1, 32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def point_id(source: Column, chunk_id: Column) -> Column:
    """Id of a chunk, the same at every ingestion."""
    return uuid_of(F.concat(source, F.lit("::"), chunk_id.cast("string")))


def cache_id(domain: Column, sub_query: Column) -> Column:
    """Id of a cached result; no domain is the domain ``_global``."""
    return uuid_of(F.concat(F.lit("cache::"), F.coalesce(domain, F.lit("_global")), F.lit("::"), sub_query))


def section_id(source: Column, header: Column) -> Column:
    """16 hex digits that all pieces of one section share."""
    return F.substring(F.sha2(F.concat(source, F.lit("::"), header), 256), 1, 16)


def content_hash(content: Column) -> Column:
    """SHA-256 of bytes (or of a text's UTF-8 bytes) in hex."""
    return F.sha2(content, 256)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*$", "")


def hidden(relative_path: Column) -> Column:
    """Whether any part of a relative path starts with a dot."""
    return relative_path.rlike(r"(^|/)\.")


#: Code, in which nothing is a link: fenced blocks and spans within one line.
_CODE = r"(?s:```.*?```)|`[^`\n]*`"


def wikilinks(text: Column) -> Column:
    """Sorted distinct targets of ``[[target#anchor|display]]`` outside of code; empty for no text.

    A link holds no closing bracket; its target is what stands before the first ``#`` or ``|``.
    """
    inner = F.regexp_extract_all(F.regexp_replace(text, _CODE, ""), F.lit(r"\[\[([^\]]+)\]\]"), 1)
    targets = F.transform(inner, lambda link: strip(F.split_part(F.translate(link, "|", "#"), F.lit("#"), F.lit(1))))
    named = F.array_sort(F.array_distinct(F.filter(targets, lambda t: t != "")))
    return F.coalesce(named, F.array().cast("array<string>"))


def embedding_text(title: Column, header: Column, text: Column) -> Column:
    """What is encoded for a chunk: a line with title and header, a blank line, the text."""
    return F.concat(title, F.lit(" › "), header, F.lit("\n\n"), text)


def passage_text(source: Column, header: Column, text: Column) -> Column:
    """What a cross-encoder reads: the note's stem, with the header if there is one, and the text."""
    stem = file_stem(source)
    head = F.when(F.coalesce(header, F.lit("")) != "", F.concat(stem, F.lit(" › "), header)).otherwise(stem)
    return F.concat(head, F.lit("\n\n"), text)


#: Fixed value: the form in which a cross-encoder reads a task, a question and a passage.
PAIR = "<Instruct>: %s\n<Query>: %s\n<Document>: %s"
INSTRUCTION = "Find the passage of the notes that answers the question"


def pair_text(query: Column, passage: Column, instruction: str = INSTRUCTION) -> Column:
    """One text for a question and a passage, for cross-encoders that take them so."""
    return F.format_string(PAIR, F.lit(instruction), query, passage)


def age_days(since: Column, today: Column) -> Column:
    """Days since an ISO date; null where there is none or it is no date."""
    valid = F.when(since.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(since, "yyyy-MM-dd"))
    return F.date_diff(today, valid)


def days_label(days: Column) -> Column:
    return F.when(days == 1, F.lit("1 Tag")).otherwise(F.concat(days.cast("string"), F.lit(" Tage")))


def domain_of(domain: Column) -> Column:
    """A domain as written by hand, in one spelling; blanks are no domain."""
    clean = strip(F.lower(domain))
    return F.when(clean != "", clean)


#: Fixed value: where a long paragraph is cut.
SENTENCE_BREAK = r"(?<=[.!?])(?U:\s)+(?=[A-ZÄÖÜ\"„*`\[])"


def sentences(paragraph: Column) -> Column:
    """Rule-based cut of one long paragraph: a mark, white space, then a capital, quote or markup sign."""
    return F.split(paragraph, SENTENCE_BREAK)


_LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def unix_lines(text: Column) -> Column:
    """Every kind of line end as one line feed."""
    return F.regexp_replace(text, _LINE_ENDS, "\n")


def front_matter(markdown: Column) -> Column:
    """The header between the first two ``---`` lines' marks; empty where the text doesn't start with one."""
    return F.when(markdown.startswith("---"), F.coalesce(F.get(F.split(markdown, "---", 3), F.lit(1)), F.lit(""))).otherwise("")


def front_matter_domain(header: Column) -> Column:
    found = F.regexp_extract(header, r"(?dm)^domain:\s*(\S+)\s*$", 1)
    return F.when(found != "", found).otherwise("?")


def front_matter_hides(header: Column) -> Column:
    """Whether ``indexed: false`` takes the note out of the index."""
    return header.rlike(r"(?dmi)^indexed:\s*false\s*$")
