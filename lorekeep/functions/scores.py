"""Numeric scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# Types that last, and the weights of the fused score with and without a query.
STABLE_TYPES = ("decision", "requirement", "architecture", "bug", "lesson", "preference")
WITH_QUERY = {"keyword": 0.15, "vector": 0.25, "importance": 0.30, "confidence": 0.10, "recency": 0.20, "type": 0.0}
WITHOUT_QUERY = {"keyword": 0.0, "vector": 0.25, "importance": 0.45, "confidence": 0.10, "recency": 0.25, "type": 0.20}


def recency(touched_ms: Column, now_ms: int) -> Column:
    """1 within a week, then falling to 0 at 180 days."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - touched_ms) / F.lit(float(DAY_MS)))
    return F.when(age <= 7, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - age / 180))


def trust(confidence: Column) -> Column:
    """1 from a confidence of 0.6; below, the share of it, 0.35 at least; null counts as 0.6."""
    c = F.coalesce(confidence, F.lit(0.6))
    return F.when(c >= 0.6, F.lit(1.0)).otherwise(F.greatest(F.lit(0.35), c / 0.6))


# Types whose records are worth more.
HIGH_VALUE_TYPES = ("decision", "architecture", "bug", "lesson", "preference")


def memory_score(importance: Column, created_ms: Column, kind: Column, now_ms: int) -> Column:
    """0.5 importance + 0.3 recency (1 within a week, then by the day to 0 at 90) + 0.2 of 1 for types of high value, else of a half."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.coalesce(created_ms, F.lit(0))) / F.lit(float(DAY_MS)))
    fresh = F.when(age <= 7, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - age / 90))
    return F.lit(0.5) * F.coalesce(importance, F.lit(0.5)) + F.lit(0.3) * fresh + F.lit(0.2) * F.when(kind.isin(*HIGH_VALUE_TYPES), 1.0).otherwise(0.5)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for unequal lengths, non-finite parts or a zero norm."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(0.0)


def priority_rank(priority: Column) -> Column:
    """urgent 0, high 1, medium and unknown 2, low 3."""
    return F.when(priority == "urgent", 0).when(priority == "high", 1).when(priority == "low", 3).otherwise(2)
