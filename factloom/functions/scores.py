"""Confidence arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: bounds of the tiers, highest first.
QUALITY_TIERS = ((0.72, "normal"), (0.45, "low-confidence"))
SUGGESTION_TIERS = ((0.72, "normal"), (0.55, "low-confidence"), (0.38, "very-low-confidence"))
#: Fixed: what is left of earlier evidence before new evidence joins it.
DECAY = 0.92


def clamp01(c: Column) -> Column:
    """Into [0, 1]; null and not-a-number are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))))


def weakest_link(a: Column, b: Column) -> Column:
    """The lower confidence and a fifth of the way to the higher."""
    low, high = F.least(clamp01(a), clamp01(b)), F.greatest(clamp01(a), clamp01(b))
    return low + (high - low) * 0.2


def tier(c: Column, bounds: tuple = QUALITY_TIERS) -> Column:
    """The name of the first bound that a confidence reaches; else suppressed."""
    out = F.lit("suppressed")
    for least, name in reversed(bounds):
        out = F.when(c >= least, name).otherwise(out)
    return out


def tier_priority(c: Column) -> Column:
    """10 for normal, 20, 30, and 40 for suppressed."""
    return F.when(c == "normal", 10).when(c == "low-confidence", 20).when(c == "very-low-confidence", 30).otherwise(40)


def saturate(c: Column) -> Column:
    """1 - exp(-x) of summed evidence; nothing or less is 0."""
    return F.when(c > 0, 1 - F.exp(-c)).otherwise(0.0)


def noisy_or(ordered: Column, decay: float = DECAY) -> Column:
    """Decayed noisy-or over an array of confidences in their order (it doesn't commute)."""
    return F.aggregate(ordered, F.lit(0.0), lambda s, c: 1 - (1 - decay * s) * (1 - c))


def salience(n: Column) -> Column:
    """Of an entity with n mentions: 0.35 + 0.12 n, at most 1."""
    return F.least(F.lit(1.0), 0.35 + 0.12 * n)


def repetition_bonus(confidence: Column, n: Column) -> Column:
    """Confidence raised for repeated sightings, where it is 0.32 or more: 0.05 each after the first, 0.12 at most, 0.95 in all."""
    bonus = F.least(F.lit(0.12), (n - 1) * 0.05)
    return F.when(confidence >= 0.32, F.greatest(confidence, F.least(F.lit(0.95), confidence + bonus))).otherwise(confidence)
