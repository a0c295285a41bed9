"""Recency, decay, importance and composite scores as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400.0


def recency(last: Column, now: Column, rate: float = 0.01) -> Column:
    """Exponential in whole days."""
    return F.exp(-rate * F.floor(days_between(last, now)))


def decay(relevance: Column, days: Column, half_life: Column) -> Column:
    factor = F.when(half_life <= 0, 1.0).otherwise(F.pow(F.lit(0.5), days / half_life))
    return relevance * factor


def days_until_stale(relevance: Column, half_life: Column, stable: Column, least: float = 0.1) -> Column:
    """Null if stable or stale already."""
    days = half_life * F.ln(F.lit(least) / relevance) / F.ln(F.lit(0.5))
    return F.when(~stable & (relevance > least), days)


def memory_importance(confidence: Column, accesses: Column, days: Column) -> Column:
    """0 for a memory that was never accessed."""
    use = F.least(F.ln(accesses + F.lit(1.0)), F.lit(3.0)) / 3.0
    return F.when(accesses == 0, 0.0).otherwise(0.5 * confidence + 0.3 * use + 0.2 * F.exp(-days))


def entity_importance(confidence: Column, accesses: Column) -> Column:
    return confidence * (1 + 0.1 * accesses)


def boosted(relevance: Column, boost: float = 0.1) -> Column:
    return F.least(F.lit(1.0), relevance + boost)


def composite(relevance: Column, recent: Column, importance: Column, coherence: Column, confidence: Column, penalty: Column) -> Column:
    value = 0.5 * relevance + 0.2 * recent + 0.2 * importance + 0.05 * coherence + 0.05 * confidence - 0.1 * penalty
    return F.greatest(F.lit(0.0), value)
