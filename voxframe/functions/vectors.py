"""Vector arithmetic on float arrays, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; null for vectors of different or no length.

    Norms below ``eps`` count as ``eps``, so a zero vector scores 0.
    """
    floor = F.lit(eps)
    value = dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def cosine_error(a: Column, b: Column) -> Column:
    """Why ``cosine`` is null, else null."""
    return (
        F.when(a.isNull() | b.isNull(), F.lit("missing vector"))
        .when(F.size(a) != F.size(b), F.lit("different lengths"))
        .when(F.size(a) == 0, F.lit("empty vector"))
    )
