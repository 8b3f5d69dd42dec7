"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10  # fixed value: a norm below this counts as zero


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Vector over its norm, all zeros for a zero vector."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > TINY, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when((norm(a) > TINY) & (norm(b) > TINY), dot(a, b) / n).otherwise(F.lit(0.0))
