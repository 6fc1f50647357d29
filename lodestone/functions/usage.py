"""Frecency: exponentially decayed use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHT, SATURATION, RECENT_SCORE, RECENT_SECONDS, HALF_LIFE_DAYS = 0.6, 3.0, 0.25, 30 * 86400, 14.0


def decay(elapsed: Column, half_life: float) -> Column:
    """Share of a score left after ``elapsed`` (same unit as the half-life)."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), elapsed.cast("double")) / half_life)


def decayed_count(at: Column, now: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """Aggregate: uses at epoch seconds ``at``, each worth what is left of 1."""
    return F.sum(decay((now - at) / 86400.0, half_life_days))


def boost(score: Column) -> Column:
    """Factor on a match score; 1 without use, below 1.6 always."""
    s = F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0)))
    return 1.0 + WEIGHT * s / (s + SATURATION)


def usage_band(last_used: Column, now: Column, launched: Column | None = None) -> Column:
    """0 never, 1 recent (30 days), 2 launched."""
    recent = F.when(last_used.isNotNull() & (F.greatest(F.lit(0), now - last_used) <= RECENT_SECONDS), 1).otherwise(0)
    return recent if launched is None else F.when(launched, 2).otherwise(recent)
