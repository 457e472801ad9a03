"""The three percentiles in use; they differ on purpose and must not be mixed up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(c: Column, p: float) -> Column:
    """Aggregate: the smallest value with at least ``p`` percent of the values up to it."""
    return F.expr(f"percentile_disc({p / 100}) within group (order by {c._jc.toString()})")


def floor_index(values: Column, p: float) -> Column:
    """The value at index ``int(p * (n - 1))`` of a sorted array; null for an empty one."""
    ordered = F.sort_array(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, (F.lit(1) + F.floor(F.lit(p) * (F.size(values) - 1))).cast("int")))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """Share rounded to ``digits``; 0 where there is nothing to share."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))
