"""Other inputs and outputs: PDF files, JSON of hits, gold sets, evaluation runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "id string, typ string, frage string, soll array<struct<notiz:string,beleg:string>>, darf_nicht array<string>"
HIT = "rank int, score double, id string, source string, source_path string, header string, text string, domain string, chunk_offset int, quelle string, geprueft string, updated string"


def scan_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of a PDF file, or of all below a folder."""
    reader = spark.read.format("binaryFile")
    if path.lower().endswith(".pdf"):
        return reader.load(path).select("path", "content")
    return reader.option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")


def parse_pdfs(pdfs: DataFrame, parser: Callable[[bytes], str]) -> DataFrame:
    """``path, markdown, error``: every file is parsed on its own; one that fails has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((path, parser(bytes(content)), None))
                except Exception as e:  # a broken file must not stop the others
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return pdfs.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold set of JSON lines; blank lines are skipped, a missing ``darf_nicht`` is empty."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", GOLD, {"mode": "FAILFAST"}).alias("g")).select("g.*")
    return rows.withColumn("darf_nicht", F.coalesce("darf_nicht", F.array().cast("array<string>")))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of JSON that is a list, or an object with ``chunks`` or ``results``; with its ``query`` where given."""
    whole = spark.read.text(path, wholetext=True)
    keyed = F.from_json("value", f"query string, chunks array<struct<{_fields(HIT)}>>, results array<struct<{_fields(HIT)}>>")
    listed = F.from_json("value", f"array<struct<{_fields(HIT)}>>")
    as_list = F.ltrim("value").startswith("[")
    hits = F.when(as_list, listed).otherwise(F.coalesce(keyed["chunks"], keyed["results"]))
    return whole.select(F.when(~as_list, keyed["query"]).alias("query"), F.explode(hits).alias("h")).select("query", "h.*")


def _fields(ddl: str) -> str:
    return ",".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON that is a list or an object with ``cases``."""
    fields = "id:string,category:string,query:string,domain:string,expected_keyword:string,expected_secondary_keyword:string,expected_source:string,test_type:string,expect_no_answer:boolean"
    whole = spark.read.text(path, wholetext=True)
    cases = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{fields}>>")).otherwise(F.from_json("value", f"struct<cases:array<struct<{fields}>>>")["cases"])
    return whole.select(F.explode(cases).alias("c")).select("c.*")


def newest_run(spark: SparkSession, folder: str, label: str) -> DataFrame:
    """The rows of the evaluation run ``*_{label}.jsonl`` with the greatest name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{label}.jsonl").load(folder)
    name = files.agg(F.max("path")).first()[0]
    if name is None:
        raise FileNotFoundError(f"no run {label} in {folder}")
    return spark.read.json(name)


def write_run(scored: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines."""
    scored.write.mode("overwrite").json(path)
