"""Distances and similarities over arrays and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either has no norm."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda v: F.slice(v, F.lit(1), n)
    norm = F.sqrt(dot(cut(a), cut(a))) * F.sqrt(dot(cut(b), cut(b)))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def distance_by(metric: str, a: list[Column], b: list[Column]) -> Column:
    """euclidean, manhattan, or cosine (1 less the cosine; 1 if either has no length)."""
    if metric == "euclidean":
        return distance(a, b)
    if metric == "manhattan":
        return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    if metric == "cosine":
        return 1 - cosine(F.array(*a), F.array(*b))
    raise ValueError(f"unknown metric {metric}")


def similarity(d: Column, threshold: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / threshold)


def unit(v: list[Column]) -> list[Column]:
    """Of length 1; a zero vector stays zero."""
    n = F.sqrt(sum((x * x for x in v), F.lit(0.0)))
    return [F.coalesce(F.try_divide(x, n), F.lit(0.0)) for x in v]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
