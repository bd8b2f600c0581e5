"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a: str | Column, b: str | Column) -> Column:
    """0 for vectors of different lengths."""
    x, y = col(a), col(b)
    total = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), total).otherwise(F.lit(0.0))


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 for null, empty, zero or unlike vectors."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def prefix(a: str | Column, dims: int) -> Column:
    """The first dims components, at unit length again (a zero vector stays)."""
    cut = F.slice(col(a), 1, dims)
    n = norm(cut)
    return F.transform(cut, lambda x: (x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))).cast("float"))
