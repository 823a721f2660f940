"""Functions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length; that of a zero vector counts as 1."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def softmax(a: Column) -> Column:
    v = a.cast("array<double>")
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def mean(a: Column) -> Column:
    v = a.cast("array<double>")
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean of the absolute differences of two arrays of one length."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
