"""Vector expressions; elements are widened to double before any arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, digits: int = 9) -> Column:
    """Cosine similarity, rounded; 0 for null, zero or differently long vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), F.round(_dot(a, b) / norms, digits)), F.lit(0.0))
