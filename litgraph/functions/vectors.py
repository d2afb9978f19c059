"""Vector column expressions (F13-F15).  Built-in higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    """widen ``array<float>`` to ``array<double>``."""
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(F.transform(as_double(v), lambda x: x * x), F.lit(0.0),
                              lambda acc, x: acc + x))


def cosine_similarity(a, b) -> Column:
    """``a·b / (|a| |b|)`` (null for a zero vector)."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def cosine_distance(a, b) -> Column:
    """``1 - cosine_similarity``."""
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_normalize(v) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n))
