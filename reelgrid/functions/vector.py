"""Expressions on embedding arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalized(v: Column) -> Column:
    """Unit-length vector; the norm has a floor, so zero vectors stay zero.

    The divisor is repeated into an array: inside a lambda it would be computed once per element.
    """
    divisor = F.array_repeat(F.greatest(norm(v), F.lit(NORM_FLOOR)), F.size(v))
    return F.zip_with(as_double(v), divisor, lambda x, n: x / n)


def conformed(v: Column, dim: int) -> Column:
    """Cut or zero-pad to ``dim`` entries."""
    return F.slice(F.concat(as_double(v), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def unit_score(similarity: Column, clamp: bool) -> Column:
    """Cosine in [-1, 1] moved to [0, 1]."""
    moved = (similarity + 1.0) / 2.0
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)) if clamp else moved
