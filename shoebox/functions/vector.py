"""Vectors as array columns: norms, products and cosine distances in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalized(a: Column) -> Column:
    """The unit vector; a vector of no length stays as it is."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / F.greatest(s["n"], F.lit(EPSILON)))), 1)


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def clipped(x: Column, low: float, high: float) -> Column:
    """Between low and high; where they cross, high."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
