"""Vector expressions on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector is similar to nothing."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.when(size.isNotNull(), 0.0))


def best_similarity(vector: Column, described: Sequence[Sequence[float]]) -> Column:
    """Largest cosine with any of a few fixed vectors, which travel in the expression itself."""
    return F.array_max(F.array(*[cosine(vector, F.lit(list(map(float, d)))) for d in described]))


def coerced(vector: Column) -> Column:
    """Array of doubles, null for an empty one."""
    return F.when(F.size(vector) > 0, F.transform(vector, lambda x: x.cast("double")))
