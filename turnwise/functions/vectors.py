"""Vector columns (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector divided by its length; null for a zero vector."""
    return F.when(norm(a) > 0, F.flatten(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / n))))


def usable(a: Column, dim: int) -> Column:
    """Whether there are ``dim`` finite numbers, not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0), F.lit(False))
