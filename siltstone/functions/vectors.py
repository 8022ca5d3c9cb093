"""Vector, set and rank functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct elements; 0 for two empty arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of distinct tokens: 2 |a & b| / (|a| + |b|)."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def coverage(query: Column, doc: Column) -> Column:
    """The matched share of the weights of ``query`` (map of token to weight) by the keys of ``doc``."""
    total = F.aggregate(F.map_values(query), F.lit(1e-9), lambda s, x: s + x)
    match = F.aggregate(F.map_values(F.map_filter(query, lambda k, _: F.map_contains_key(doc, k))), F.lit(1e-9), lambda s, x: s + x)
    return match / total


def min_max(value: Column, *by: str) -> Column:
    """Scaled to 0..1 inside the partition; all 0 if it is flat."""
    w = Window.partitionBy(*by)
    low = F.min(value).over(w)
    return F.coalesce(F.try_divide(value - low, F.max(value).over(w) - low), F.lit(0.0))


def blend(title: Column, content: Column, share: float = 0.1) -> Column:
    """The weighted sum of two vectors."""
    return F.zip_with(title, content, lambda x, y: share * x + (1 - share) * y)


def max_sim(query: Column, doc: Column) -> Column:
    """V3: late interaction of two arrays of vectors: the sum over query vectors of the best inner product."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def sparse_dot(a: Column, b: Column) -> Column:
    """V3: inner product of two sparse vectors (maps)."""
    return F.aggregate(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x * y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)
