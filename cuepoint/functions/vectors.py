"""Vector expressions; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine where both have unit length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, p: total + p)


def normalised(v: Column) -> Column:
    """The vector at unit length; null for a zero vector."""
    v = v.cast("array<double>")
    norm = F.nullif(F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)), F.lit(0.0))
    return F.transform(v, lambda x: x / norm)
