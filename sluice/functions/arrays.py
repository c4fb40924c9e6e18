"""Arithmetic on arrays of numbers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def all_finite(a: Column) -> Column:
    """True if no element is null, NaN or infinite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def blend(a: Column, b: Column, weight: Column) -> Column:
    """The convex blend of two arrays."""
    return F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight))


def points(a: Column, width: int = 3) -> Column:
    """An array cut into points of ``width`` numbers; the rest is left."""
    starts = F.sequence(F.lit(0), F.floor(F.size(a) / width).cast("int") - 1)
    return F.transform(starts, lambda i: F.slice(a, i * width + 1, width))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
