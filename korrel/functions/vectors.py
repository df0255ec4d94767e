"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product; null for vectors of different length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    """The length of a vector."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of unit vectors: their dot product within -1 and 1; null for different lengths."""
    d = dot(a, b)  # greatest and least pass over nulls
    return F.when(d.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)))


def unit(v: Column) -> Column:
    """A vector of length 1; unchanged if its length is next to nothing."""
    # the length is an array of one, so that it isn't taken again for every element
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 1e-8, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v.cast("array<float>")))[0]


def usable(v: Column) -> Column:
    """Whether a vector is there, has no NaN or null, and isn't all zeros."""
    return v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
