"""Column functions over vectors and similarity scores."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

FLOOR, CEILING = 0.18, 0.95


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def distance_to_score(distance: Column) -> Column:
    """X2"""
    score = F.when(distance <= 2, 1 - distance / 2).otherwise(1 / (1 + distance))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def confidence_bounds(score: Column) -> Column:
    """F7"""
    return F.when(score < FLOOR, 0.0).otherwise(F.least(score, F.lit(CEILING)))


def min_max(score: Column, *partition: str) -> Column:
    """Scaled to 0..1 within the partition; where all are equal, the clamped score itself."""
    w = Window.partitionBy(*partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(high - low < 1e-6, clamp(score)).otherwise(clamp(F.try_divide(score - low, high - low)))


def is_usable(vector: Column, dimension: int) -> Column:
    """of the dimension and not all zero."""
    return (F.size(vector) == dimension) & F.exists(vector, lambda x: x != 0)
