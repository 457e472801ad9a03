"""All queries of the core library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mneme.plans import data_care, details, indexing, reporting, searching, texts

_MODULES = (data_care, texts, indexing, searching, reporting, details)
FLAGSHIP = "search_batch"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
