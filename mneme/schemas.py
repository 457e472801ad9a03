"""Schemas of the engine's tables, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = "text string, source string, chunk_id int, header string, section_id string, document_title string, dense array<float>, sparse map<int,float>, colbert array<array<float>>"
POINT = (
    "point_id string, text string, source string, source_path string, chunk_id int, chunk_offset int, header string, domain string, run_id string, content_hash string, "
    "updated string, geprueft string, quelle string, links array<string>, dense array<float>, sparse map<int,float>, colbert array<array<float>>"
)
HIT = (
    "rank int, score double, id string, source string, source_path string, header string, text string, domain string, chunk_offset int, quelle string, geprueft string, updated string, rerank_score double"
)
CACHE = "cache_id string, sub_query string, sub_query_normalized string, domain string, created_at timestamp, hit_count int, dense array<float>, chunks array<string>"
GOLD_CASE = "id string, typ string, frage string, soll array<struct<notiz:string,beleg:string>>, darf_nicht array<string>"
ITEM = "note string, domain string, done boolean, marker string, since string, title string, text string"

#: Fields of a hit's payload that are answers' own fields; the rest is metadata.
FIXED = ("id", "text", "source", "score", "header")


def check_width(points: DataFrame, width: int, column: str = "colbert") -> None:
    """Fail if any multi-vector has rows of another width than the store's."""
    odd = points.where(F.exists(column, lambda r: F.size(r) != width)).limit(1).collect()
    if odd:
        raise ValueError(f"{column} has rows that are not {width} wide")


def check_request(query: str, top_k: int, most: int = 50, budget: int | None = None) -> None:
    """Bounds of a request: query of 1..10,000 characters, 1..``most`` hits, compression to 100..4,000 characters."""
    if not 1 <= len(query) <= 10_000:
        raise ValueError("a query has 1 to 10,000 characters")
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k is 1 to {most}")
    if budget is not None and not 100 <= budget <= 4000:
        raise ValueError("a hit is cut to 100 to 4,000 characters")


def metadata(hits: DataFrame, fixed: tuple[str, ...] = FIXED) -> DataFrame:
    """Hits with all other fields as one JSON column ``metadata``; nulls are left out."""
    rest = [c for c in hits.columns if c not in fixed]
    return hits.select(*[c for c in hits.columns if c in fixed], F.to_json(F.struct(*rest)).alias("metadata"))
