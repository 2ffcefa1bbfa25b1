"""Ordered classification rules. The thresholds and labels are fixed values of the analyses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify_omission(delta_r2: Column, delta_spearman: Column, alternative_r2: Column) -> Column:
    """How a result reacts when one member of the target is left out."""
    dropped = (alternative_r2 <= 0) | (F.least(delta_r2, delta_spearman) <= -0.10)
    small = F.greatest(F.abs(delta_r2), F.abs(delta_spearman)) <= 0.05
    return (
        F.when(dropped, "weakened")
        .when((delta_r2 > 0.05) & (delta_spearman >= -0.05), "stronger_after_omission")
        .when(small, "stable")
        .otherwise("mixed_or_partial")
    )


def classify_definition(
    base_r2: Column, other_r2: Column, third_r2: Column, robust: float = 0.05, moderate: float = 0.10
) -> Column:
    """Robustness of a result to the way the target is defined."""
    worst = F.greatest(F.abs(other_r2 - base_r2), F.abs(third_r2 - base_r2))
    return (
        F.when((worst <= robust) & (F.least(other_r2, third_r2) > 0), "robust")
        .when(worst <= moderate, "moderately sensitive")
        .otherwise("composition-sensitive")
    )


def range_position(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, "below").when(value > high, "above").otherwise("within")
