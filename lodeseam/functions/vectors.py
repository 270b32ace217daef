"""Vector similarity as Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


#: Measure, and whether the largest is the nearest.
METRICS = {"cosine": (cosine, True), "dotproduct": (dot, True), "euclidean": (euclidean, False)}


def valid(vector: Column, dimension: int) -> Column:
    """A vector of the dimension, without nulls."""
    return F.coalesce((F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
