"""Vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def weighted(a: Column, b: Column, wa: float = 0.85, wb: float = 0.15) -> Column:
    """The weighted sum of two vectors, at unit length; null where that is zero."""
    s = F.zip_with(doubles(a), doubles(b), lambda x, y: x * wa + y * wb)
    return F.when(norm(s) > 0, F.transform(s, lambda x: x / norm(s)))


def literal(v: Column, decimals: int = 6) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(doubles(v), lambda x: F.format_number(x, decimals)), ","), F.lit("]"))


def is_valid(v: Column, size: int) -> Column:
    return F.coalesce((F.size(v) == size) & F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
