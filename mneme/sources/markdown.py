"""Notes as Markdown files with a YAML header of flat keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mneme.functions import text as tx

#: Single-valued properties that are kept.
CURATION = ("updated", "geprueft", "quelle")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, relative, content, markdown`` of all visible ``.md`` files below ``root``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + _quoted(root.replace("file://", "")) + "/*", "")
    rows = files.select("path", relative.alias("relative"), "content", F.decode("content", "UTF-8").alias("markdown"))
    return rows.where(~tx.hidden(F.col("relative")))


def _quoted(text: str) -> str:
    return "\\Q" + text.rstrip("/") + "\\E"


def _value(header: Column, key: str) -> Column:
    """A flat YAML value, of one line or with indented lines that continue it, without quotes; null where unset or empty."""
    raw = F.regexp_extract(header, rf"(?m)^{key}:[ \t]*(.*(?:\n[ \t]+\S.*)*)", 1)
    raw = tx.strip(F.regexp_replace(tx.strip(raw), r"^[>|][-+]?\s+", ""))
    bare = F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")
    bare = F.regexp_replace(bare, r"\s+#.*$", "")
    return F.when(~F.lower(bare).isin("", "null", "~"), bare)


def parse(notes: DataFrame, markdown: str = "markdown") -> DataFrame:
    """``notes`` with ``body, domain, updated, geprueft, quelle, skip, error``.

    A header is what stands between a first line ``---`` and the next one. ``indexed: false`` beats
    everything else: such notes are skipped and need no domain. A missing or blank domain is an
    error. Properties have single blanks and harmless section marks; unset ones are null.
    """
    split = r"(?s)^---[ \t]*\r?\n(.*?)(?:^|\n)---[ \t]*(?:\r?\n|$)(.*)$"
    has = F.col(markdown).rlike(split)
    header = F.when(has, F.regexp_extract(markdown, split, 1)).otherwise("")
    body = F.when(has, F.regexp_extract(markdown, split, 2)).otherwise(F.col(markdown))
    skip = F.coalesce(F.lower(_value(header, "indexed")) == "false", F.lit(False))
    domain = tx.sanitize(tx.strip(_value(header, "domain")))
    values = [tx.sanitize(tx.collapse(tx.strip(_value(header, k)))).alias(k) for k in CURATION]
    error = F.when(~skip & F.coalesce(domain == "", F.lit(True)), "no domain; indexed: false skips a note")
    return notes.select("*", tx.strip(body).alias("body"), domain.alias("domain"), *values, skip.alias("skip"), error.alias("error"))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Parsed notes with ``content_hash`` (of the bytes) and their ``links``."""
    rows = parse(scan(spark, root))
    return rows.withColumn("content_hash", tx.content_hash(F.col("content"))).withColumn("links", tx.wikilinks(F.col("body"))).drop("content")
