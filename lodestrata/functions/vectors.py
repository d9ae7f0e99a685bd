"""Vector arithmetic on ARRAY<DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def blended(same: Column, a: Column, b: Column) -> Column:
    """Cosine of unit vectors that carry a one-hot label of weight 0.65 beside the vector's 0.35."""
    return F.when(same, F.lit(0.65)).otherwise(F.lit(0.0)) + F.lit(0.35) * dot(a, b)
