"""Exploratory summaries: patterns, spread, outliers, correlation, trend."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airspark.functions import labels
from airspark.functions.numbers import ratio
from airspark.functions.timefn import clock_label, month_label
from airspark.operators.comoments import comoments
from airspark.operators.quality import missing_overall
from airspark.operators.quantiles import equal_width_bin, long_values, quantiles, value_edges
from airspark.operators.series import day_bucket, running_totals
from airspark.schema import POLLUTANTS, STATION, TS

PATTERN_COLUMNS = ["pm2_5", "pm10", "o3"]
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
REACH = 1.5
CALENDAR = ["hour", "day", "month"]


def numeric_columns(df: DataFrame) -> list[str]:
    """Measured columns: numbers, without the key and the calendar."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if t in numeric and n not in (STATION, *CALENDAR)]


def mean_by(df: DataFrame, key: str | list[str], columns: list[str] = PATTERN_COLUMNS) -> DataFrame:
    by = [key] if isinstance(key, str) else key
    return df.groupBy(STATION, *by).agg(*[F.avg(c).alias(c) for c in columns])


def weekly_pattern(df: DataFrame, columns: list[str] = PATTERN_COLUMNS, ts: str = TS) -> DataFrame:
    named = df.withColumns({"day_of_week": F.weekday(ts), "day_name": F.date_format(ts, "EEEE")})
    return mean_by(named, ["day_of_week", "day_name"], columns)


def _moments(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    stats = df.groupBy(*keys).agg(
        *[
            F.struct(
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return stats.unpivot(keys, columns, "feature", "_s").select(*keys, "feature", "_s.*")


def describe(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    keys, columns = keys or [STATION], columns or numeric_columns(df)
    spread = quantiles(df, columns, QUARTILES, keys)
    return _moments(df, columns, keys).join(spread, [*keys, "feature"]).withColumnRenamed("n", "count")


def fences(quartiles: DataFrame) -> DataFrame:
    reach = (F.col("q75") - F.col("q25")) * REACH
    return quartiles.withColumns({"lower": F.col("q25") - reach, "upper": F.col("q75") + reach})


def _fenced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every value beside the quartiles and fences of its station and column."""
    bounds = fences(quantiles(df, columns, QUARTILES)).drop("n")
    return long_values(df, columns, [STATION]).join(bounds, [STATION, "feature"])


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values beyond the fences on either side; the share is of all rows."""
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    found = _fenced(df, columns).groupBy(STATION, "feature", "lower", "upper").agg(F.count_if(out).alias("outliers"))
    rows = df.groupBy(STATION).agg(F.count("*").alias("_rows"))
    share = (F.col("outliers") * 100.0 / F.col("_rows")).alias("outlier_pct")
    return found.join(rows, STATION).select(STATION, "feature", "lower", "upper", "outliers", share)


def iqr_upper(df: DataFrame, columns: list[str]) -> DataFrame:
    above = F.count_if(F.col("value") > F.col("upper"))
    return _fenced(df, columns).groupBy(STATION, "feature", "upper").agg(above.alias("extreme_events"))


def box_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, and the extreme values that lie inside the fences."""
    kept = F.when(F.col("value").between(F.col("lower"), F.col("upper")), F.col("value"))
    return (
        _fenced(df, columns)
        .groupBy(STATION, "feature", "q25", "q50", "q75")
        .agg(F.min(kept).alias("whisker_low"), F.max(kept).alias("whisker_high"))
    )


def histogram(df: DataFrame, columns: list[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes; the last one is closed."""
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    bin_ = equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    return (
        long_values(df, columns, [STATION])
        .join(value_edges(df, columns, [STATION]), [STATION, "feature"])
        .groupBy(STATION, "feature", "low", width.alias("_width"), bin_.alias("bin"))
        .agg(F.count("*").alias("count"))
        .select(STATION, "feature", "bin", (F.col("low") + F.col("bin") * F.col("_width")).alias("bin_from"), "count")
    )


def histogram_overlay(baseline: DataFrame, current: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """Two populations on shared edges, each as shares of its own total."""
    both = baseline.withColumn("population", F.lit("baseline")).unionByName(
        current.withColumn("population", F.lit("current"))
    )
    by = [STATION, "population", "feature"]
    bin_ = equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    binned = (
        long_values(both, columns, [STATION, "population"])
        .join(value_edges(both, columns, [STATION]), [STATION, "feature"])
        .groupBy(*by, bin_.alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    whole = F.sum("count").over(Window.partitionBy(*by))
    return binned.withColumn("probability", F.col("count") / whole)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, over the rows where both are present.

    One row per station and ordered pair. A constant column gives NULL.
    """
    return comoments(df, [(c, c) for c in columns] + list(combinations(columns, 2)))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    upper = correlations(df, columns)
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    # A pair of a column with itself has no mirror image.
    sides = F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)
    return upper.select(STATION, "r", F.inline(sides)).select(STATION, "a", "b", "r")


def correlations_with(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Correlation of each column with the target, both present."""
    return comoments(df, [(c, target) for c in columns]).select(STATION, F.col("a").alias("feature"), "r")


def corr_ranked(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Features by correlation, with the strongest by absolute value marked."""
    found = correlations_with(df, target, columns)
    by = Window.partitionBy(STATION)
    ranked = F.row_number().over(by.orderBy(F.col("r").desc_nulls_last(), "feature"))
    strongest = F.row_number().over(by.orderBy(F.abs("r").desc_nulls_last(), "feature")) == 1
    return found.withColumns({"rank": ranked, "strongest": strongest & F.col("r").isNotNull()})


def _extreme(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Key of the largest and smallest mean per column; the smaller key wins a tie."""
    long = mean_by(df, key, columns).unpivot([STATION, key], columns, "feature", "_m").where(F.col("_m").isNotNull())
    top = F.max(F.struct(F.col("_m"), (-F.col(key)).alias("k")))
    bottom = F.min(F.struct(F.col("_m"), F.col(key).alias("k")))
    return long.groupBy(STATION, "feature").agg((-top["k"]).alias("peak"), bottom["k"].alias("low"))


def hour_extremes(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    found = _extreme(df, "hour", columns)
    return found.select(
        STATION,
        "feature",
        F.col("peak").alias("peak_hour"),
        F.col("low").alias("low_hour"),
        clock_label(F.col("peak")).alias("peak_label"),
        clock_label(F.col("low")).alias("low_label"),
    )


def peak_month(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    return _extreme(df, "month", columns).select(
        STATION, "feature", F.col("peak").alias("peak_month"), month_label(F.col("peak"), "MMMM").alias("month_name")
    )


def distribution_shape(df: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    """Bias-corrected skewness and the word for it."""

    def corrected(c: str) -> Column:
        n = F.count(c).cast("double")
        factor = ratio(F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))), n - 2)
        return F.when((n >= 3) & (F.min(c) < F.max(c)), F.skewness(c) * factor).alias(c)

    wide = df.groupBy(STATION).agg(*[corrected(c) for c in columns])
    long = wide.unpivot([STATION], columns, "feature", "skew")
    return long.withColumn("shape", labels.skew_shape(F.col("skew")))


def trend_slope(df: DataFrame, columns: list[str] = POLLUTANTS, ts: str = TS) -> DataFrame:
    """Least-squares slope over the position among present values, per day."""
    places = {f"_x_{c}": F.col(c).isNotNull().cast("bigint") for c in columns}
    placed = running_totals(df.select(STATION, ts, *columns), places, day_bucket(ts), [STATION], [ts], totals=False)
    wide = placed.groupBy(STATION).agg(*[(F.regr_slope(c, F.col(f"_x_{c}") - 1) * 24).alias(c) for c in columns])
    long = wide.unpivot([STATION], columns, "feature", "per_day")
    return long.withColumn("trend", labels.trend(F.col("per_day")))


def eda_report(df: DataFrame, names: list[str]) -> DataFrame:
    """Key findings of each station as rows of section, metric, value, label."""
    none = F.lit(None).cast("string")
    keys = [STATION]

    def rows(frame: DataFrame, section: str, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
        items = F.array(
            *[
                F.struct(
                    F.lit(section).alias("section"), F.lit(m).alias("metric"), v.cast("double").alias("value"), t.alias("label")
                )
                for m, (v, t) in metrics.items()
            ]
        )
        return frame.select(STATION, F.inline(items))

    c = F.col
    stats = rows(
        describe(df, ["pm2_5"], keys),
        "statistics",
        {m: (c(s), none) for m, s in (("mean", "mean"), ("median", "q50"), ("std", "std"), ("min", "min"), ("max", "max"))},
    )
    hour = rows(_extreme(df, "hour", ["pm2_5"]), "temporal", {"peak_hour": (c("peak"), none)})
    month = rows(_extreme(df, "month", ["pm2_5"]), "temporal", {"peak_month": (c("peak"), month_label(c("peak")))})
    best = corr_ranked(df, "pm2_5", [p for p in POLLUTANTS if p != "pm2_5"]).where("strongest")
    corr = rows(best, "correlation", {"strongest": (c("r"), c("feature"))})
    missing = rows(missing_overall(df, names), "quality", {"missing_pct": (c("missing_pct"), none)})
    return stats.unionByName(hour).unionByName(month).unionByName(corr).unionByName(missing)
