"""Vectors as arrays of double: products, norms, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import text as t


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays zero. The norm is computed once a vector."""
    return t.let(a, lambda x: t.let(norm(x), lambda n: F.transform(x, lambda e: F.when(n > 0, e / n).otherwise(0.0))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def softmax_first(scores: Column) -> Column:
    """The first score's share in the softmax of all of them."""
    top = F.array_max(scores)
    return F.exp(F.element_at(scores, 1) - top) / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
