"""Drift of current values against a baseline, per station and column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airspark.functions.numbers import ratio
from airspark.operators.quantiles import long_values, quantiles
from airspark.operators.steps import counted_bins, steps
from airspark.schema import STATION

EPSILON = 1e-6
THRESHOLD = 0.2
THRESHOLDS = {"aqi": 0.15}
OUTSIDE_LIMIT = 0.3
MONITORED = ["aqi", "pm2_5", "pm10", "o3", "no2"]
ALERT_PCT = 20
_BASE = "_base"


def flagged(df: DataFrame, is_baseline: Column) -> DataFrame:
    """One frame that holds both samples; rows where the condition is null belong to neither."""
    return df.withColumn(_BASE, is_baseline).where(F.col(_BASE).isNotNull())


def _both(baseline: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    keep = [STATION, *columns]
    return (
        baseline.select(*keep)
        .withColumn(_BASE, F.lit(True))
        .unionByName(current.select(*keep).withColumn(_BASE, F.lit(False)))
    )


def _moments(both: DataFrame, columns: list[str]) -> DataFrame:
    wide = both.groupBy(STATION, _BASE).agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns]
    )
    return wide.unpivot([STATION, _BASE], columns, "feature", "_s").select(STATION, _BASE, "feature", "_s.*")


def _counts() -> dict[str, Column]:
    return {"n_base": F.col(_BASE), "n_current": ~F.col(_BASE)}


def drift_metrics(
    baseline: DataFrame, current: DataFrame, columns: list[str], thresholds: dict[str, float] | None = None
) -> DataFrame:
    return metrics(_both(baseline, current, columns), columns, thresholds)


def metrics(both: DataFrame, columns: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """Moments and quantiles of both samples, their relative differences, and a verdict.

    ``both`` is a ``flagged`` frame. Stations that lack one of the samples give no row.
    """
    by = [STATION, "feature"]
    spread = quantiles(both, columns, {"p05": 0.05, "median": 0.5, "p95": 0.95}, [STATION, _BASE])
    stats = _moments(both, columns).join(spread, [STATION, _BASE, "feature"])
    pair = stats.groupBy(*by).agg(
        *[F.max(F.when(F.col(_BASE), F.col(c))).alias(f"base_{c}") for c in ("mean", "std", "median", "p05", "p95")],
        *[F.max(F.when(~F.col(_BASE), F.col(c))).alias(f"current_{c}") for c in ("mean", "std", "median")],
    )
    # The grouping keys carry the statistics along: one pass over the current values.
    below_or_above = (F.col("value") < F.col("base_p05")) | (F.col("value") > F.col("base_p95"))
    out = (
        long_values(both.where(~F.col(_BASE)), columns, [STATION])
        .join(pair.where(F.col("base_mean").isNotNull()), by)
        .groupBy(*pair.columns)
        .agg((F.count_if(below_or_above) / F.count("*")).alias("outside_share"))
    )
    c = F.col
    gap = F.abs(c("current_mean") - c("base_mean"))
    limit = F.lit(THRESHOLD)
    for name, value in (THRESHOLDS if thresholds is None else thresholds).items():
        limit = F.when(c("feature") == name, F.lit(value)).otherwise(limit)
    out = out.withColumns(
        {
            "threshold": limit,
            "mean_diff": ratio(gap, c("base_std") + EPSILON),
            "mean_diff_absolute": ratio(gap, F.abs(c("base_mean")) + EPSILON),
            "median_diff": ratio(F.abs(c("current_median") - c("base_median")), F.abs(c("base_median")) + EPSILON),
            "std_diff": ratio(F.abs(c("current_std") - c("base_std")), c("base_std") + EPSILON),
        }
    )
    signs = [c(n) > c("threshold") for n in ("mean_diff", "mean_diff_absolute", "median_diff", "std_diff")]
    signs.append(c("outside_share") > OUTSIDE_LIMIT)
    verdict = F.lit(False)
    for sign in signs:
        verdict = verdict | F.coalesce(sign, F.lit(False))
    return out.withColumn("drift", verdict)


def drift_status(baseline: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or MONITORED
    return status(_both(baseline, current, columns), columns)


def status(both: DataFrame, columns: list[str] | None = None) -> DataFrame:
    out = metrics(both, columns or MONITORED)
    return out.select(STATION, "feature", "threshold", "drift", "mean_diff", "median_diff", "std_diff", "outside_share")


def drift_causes(baseline: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    return causes(_both(baseline, current, columns), columns)


def causes(both: DataFrame, columns: list[str]) -> DataFrame:
    """Size and direction of the shift of each drifted column."""
    base, now = F.col("base_mean"), F.col("current_mean")
    shift = F.when(base != 0, ratio(now - base, base) * 100).otherwise(F.when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    outside = F.col("outside_share") * 100
    return (
        metrics(both, columns, thresholds={})
        .where("drift")
        .select(
            STATION,
            "feature",
            F.abs(shift).alias("shift_pct"),
            F.when(shift > 0, F.lit("Higher")).otherwise(F.lit("Lower")).alias("direction"),
            F.when(shift > 0, F.lit("Spike detected")).otherwise(F.lit("Drop detected")).alias("description"),
            base,
            now,
            outside.alias("outside_pct"),
            (outside > ALERT_PCT).alias("alert"),
        )
    )


def drift_ks(baseline: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    return ks(_both(baseline, current, columns), columns)


def ks(both: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per station and column.

    Within a bin the shares of both samples only grow, so the bin bounds its largest gap.
    Only bins that may exceed the best gap at a bin's end are looked at value by value.
    """
    by = [STATION, "feature"]
    long = long_values(both, columns, [STATION, _BASE])

    def share(name: str, upto: bool) -> Column:
        held = F.col(f"before_{name}") + F.col(name) if upto else F.col(f"before_{name}")
        return ratio(held, F.col(f"total_{name}"))

    at_end = F.abs(share("n_base", True) - share("n_current", True))
    at_most = F.greatest(share("n_base", True) - share("n_current", False), share("n_current", True) - share("n_base", False))
    best = F.max(at_end).over(Window.partitionBy(*by))
    bins = counted_bins(long, by, _counts())
    exact = steps(long, bins, by, _counts(), lambda parts: parts.withColumn("near", F.coalesce(at_most > best, F.lit(False))))
    return exact.groupBy(*by).agg(
        F.max(at_end).alias("ks"), F.max("total_n_base").alias("n_base"), F.max("total_n_current").alias("n_current")
    )
