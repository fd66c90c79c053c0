"""Scoring functions of the risk model, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the risk bands.
HIGH_RISK, MEDIUM_RISK = 60.0, 25.0


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def risk_band(score: Column) -> Column:
    return F.when(score >= HIGH_RISK, "altamente_sospechoso").when(score >= MEDIUM_RISK, "sospechoso").otherwise("poco_sospechoso")


def quarter_score(points: Column) -> Column:
    """Points out of four as a percentage, for metadata, text and consistency checks."""
    return clamp(points.cast("double") / F.lit(4.0) * F.lit(100.0))


def typography_score(key_hits: Column, other_hits: Column) -> Column:
    return clamp(key_hits * F.lit(35.0) + other_hits * F.lit(15.0))


def global_error_score(max_difference: Column, anomaly: Column, threshold: int = 35) -> Column:
    over = F.greatest(F.lit(0), max_difference - threshold) * F.lit(1.5)
    near = F.lit(25.0) + max_difference / F.lit(float(max(1, threshold))) * F.lit(20.0)
    return F.when(anomaly, clamp(F.lit(55.0) + over)).when(max_difference >= max(18, int(threshold * 0.7)), clamp(near)).otherwise(F.lit(0.0))


def region_error_score(max_difference: Column, anomaly: Column, is_key: Column, threshold: int = 20) -> Column:
    weight = F.when(is_key, F.lit(1.45)).otherwise(F.lit(1.0))
    over = F.lit(78.0) + F.greatest(F.lit(0), max_difference - threshold) * F.lit(1.5)
    margin = F.lit(threshold) - max_difference
    near = F.lit(10.0) + F.greatest(F.lit(0), F.lit(4) - margin) * F.lit(2.0)
    return F.when(anomaly, clamp(over * weight)).when(max_difference > threshold, clamp(F.lit(30.0) * weight)).when(margin <= 4, clamp(near * weight)).otherwise(F.lit(0.0))


def difference_tier(expected: Column, observed: Column, ratio: float = 0.015, least: float = 1.0) -> Column:
    """``ok``, ``leve`` or ``inconsistente``; ``unreliable`` beyond a factor of ten; null without both amounts."""
    larger, smaller = F.greatest(F.abs(expected), F.abs(observed)), F.least(F.abs(expected), F.abs(observed))
    tolerance = F.greatest(F.lit(least), F.abs(expected) * F.lit(ratio))
    delta = F.abs(expected - observed)
    # The ratio is only formed where it is asked for: division by zero is an error in ANSI mode.
    far = F.when(smaller > 0, larger > smaller * F.lit(10.0)).otherwise(F.lit(False))
    tier = F.when(far, "unreliable").when(delta <= tolerance, "ok").when(delta <= tolerance * 3, "leve").otherwise("inconsistente")
    return F.when(expected.isNotNull() & observed.isNotNull(), tier)


def difference_points(tier: Column) -> Column:
    return F.when(tier == "leve", 1).when(tier == "inconsistente", 2).otherwise(0)
