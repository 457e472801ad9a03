"""Vector expressions in double precision, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null, empty or zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def unit(a: Column) -> Column:
    """The vector at length one, as doubles; a zero vector stays zero."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def max_sim(query_units: Column, document_units: Column) -> Column:
    """Sum over the query's rows of the best dot product with any of the document's rows (late interaction)."""
    plain = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    best = F.transform(query_units, lambda q: F.array_max(F.transform(document_units, lambda d: plain(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps id -> weight over their shared ids; null where either is null."""
    shared = F.filter(F.map_keys(a), lambda k: F.map_contains_key(b, k))
    return F.when(b.isNotNull(), F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(a, k).cast("double") * F.element_at(b, k).cast("double")))


def pool_dense(rows: Column) -> Column:
    """Mean of token vectors, brought to length one."""
    count = F.size(rows)
    first = F.transform(F.get(rows, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(rows, first, lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))
    return F.when(count > 0, unit(F.transform(total, lambda x: x / count)))
