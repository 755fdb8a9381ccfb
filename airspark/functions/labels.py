"""Words and scores derived from summary numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thresholds and the words for them.
TREND_WORDS = (
    ("above", 1.0, "worsening rapidly"),
    ("above", 0.1, "increasing slightly"),
    ("below", -1.0, "improving rapidly"),
    ("below", -0.1, "decreasing slightly"),
)
TREND_FLAT = "stable"
SKEW_RIGHT, SKEW_LEFT, SKEW_NONE = "Highly Skewed (Right)", "Highly Skewed (Left)", "Normal / Balanced"
CONFIDENCE_WORDS = ((85, "Very High"), (70, "High"), (55, "Moderate"), (40, "Low"))
CONFIDENCE_FLOOR = "Very Low"
ACCURACY_WORDS = ((90, "Very High"), (80, "High"))
ACCURACY_FLOOR = "Moderate"
RMSE_PENALTIES = ((50, 0.8), (30, 0.9))
MAE_PENALTIES = ((40, 0.85), (25, 0.95))


def _missing(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(None).cast("string"))


def trend(per_day: Column) -> Column:
    out = _missing(per_day)
    for side, bound, word in TREND_WORDS:
        out = out.when(per_day > bound if side == "above" else per_day < bound, F.lit(word))
    return out.otherwise(F.lit(TREND_FLAT))


def skew_shape(skew: Column) -> Column:
    return _missing(skew).when(skew > 1, SKEW_RIGHT).when(skew < -1, SKEW_LEFT).otherwise(SKEW_NONE)


def at_least(value: Column, words, floor: str) -> Column:
    out = _missing(value)
    for bound, word in words:
        out = out.when(value >= bound, F.lit(word))
    return out.otherwise(F.lit(floor))


def _penalty(error: Column, steps) -> Column:
    out = F.when(error.isNull(), F.lit(steps[0][1]))
    for bound, factor in steps:
        out = out.when(error > bound, F.lit(factor))
    return out.otherwise(F.lit(1.0))


def confidence(r2: Column, rmse: Column, mae: Column) -> Column:
    """Score from 0 to 100: R² cut down for large errors."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(r2, F.lit(0.0)) * 100))
    return base * _penalty(rmse, RMSE_PENALTIES) * _penalty(mae, MAE_PENALTIES)


def display_accuracy(rmse: Column) -> Column:
    """Display score: error mapped to 0–100, upper quarter moved half-way up."""
    plain = F.greatest(F.lit(0.0), F.lit(100.0) - rmse / 3.5)
    return F.when(plain > 75, plain + (F.lit(100.0) - plain) * 0.5).otherwise(plain)
