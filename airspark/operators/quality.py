"""Data-quality reports: missing values, rules, gaps, age and schema alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from airspark.functions.numbers import clean, coerce
from airspark.functions.timefn import HOUR_US, age_label, hours_between, instant, micros, naive_utc
from airspark.operators.series import row_windowed
from airspark.schema import POLLUTANTS, STATION, TS

# Accepted ranges and thresholds in hours.
PM25_RANGE = (0, 200)
GAP_MEAN, GAP_MIN, GAP_MAX = (0.9, 1.1), 0.8, 1.5
STALE_HOURS, SEVERE_HOURS = 2, 12


def coerce_columns(df: DataFrame, names: list[str] = POLLUTANTS) -> DataFrame:
    return df.withColumns({n: coerce(F.col(n)) for n in names if n in df.columns})


def utc_normalise(df: DataFrame, text: str, ts: str = TS) -> DataFrame:
    return df.withColumn(ts, naive_utc(F.col(text)))


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the table's columns in order; absent ones are NULL, unknown ones go."""
    present = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(present[f.name.lower()]) if f.name.lower() in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def evolve_schema(stored: T.StructType, wanted: T.StructType) -> T.StructType:
    """The stored columns followed by wanted ones that are new."""
    have = {f.name.lower() for f in stored}
    return T.StructType(list(stored) + [f for f in wanted if f.name.lower() not in have])


def complete_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def range_check(df: DataFrame, column: str = "pm2_5", bounds=PM25_RANGE) -> DataFrame:
    good = F.coalesce(F.col(column).between(*bounds), F.lit(False))
    return df.groupBy(STATION).agg(
        F.bool_and(good).alias("in_range"), F.count_if(~good).alias("violations"), F.count("*").alias("rows")
    )


def quality_rules() -> dict[str, Column]:
    """Rules a row must meet where its values are present."""
    c = F.col
    rules = {f"{p}_not_negative": c(p) >= 0 for p in POLLUTANTS}
    rules["pm2_5_not_above_pm10"] = c("pm2_5") <= c("pm10")
    rules["pm2_5_below_1000"] = c("pm2_5") < 1000
    rules["pm10_below_1000"] = c("pm10") < 1000
    rules["hour_valid"] = c("hour").between(0, 23)
    rules["day_valid"] = c("day").between(1, 31)
    rules["month_valid"] = c("month").between(1, 12)
    return rules


def rule_violations(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Violations per rule, all rules in one pass over the rows."""
    rules = rules or quality_rules()
    counted = df.groupBy(STATION).agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([STATION], list(rules), "rule", "violations")


def missing_report(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Columns with missing values, their count and share in percent."""
    names = names or [c for c in df.columns if c != STATION]
    counted = df.groupBy(STATION).agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(n).isNull()).alias(n) for n in names]
    )
    long = counted.unpivot([STATION, "_rows"], names, "column_name", "missing")
    return long.where(F.col("missing") > 0).select(
        STATION, "column_name", "missing", (F.col("missing") * 100.0 / F.col("_rows")).alias("missing_pct")
    )


def missing_overall(df: DataFrame, names: list[str]) -> DataFrame:
    nulls = sum((F.col(n).isNull().cast("int") for n in names), F.lit(0))
    return df.groupBy(STATION).agg((F.sum(nulls) * 100.0 / (F.count("*") * len(names))).alias("missing_pct"))


def table_stats(df: DataFrame, ts: str = TS) -> DataFrame:
    columns = len(df.columns)
    return df.groupBy(STATION).agg(
        F.count("*").alias("rows"),
        F.lit(columns).alias("columns"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.floor((micros(F.max(ts)) - micros(F.min(ts))) / F.lit(24.0 * HOUR_US)).alias("span_days"),
    )


def interval_check(df: DataFrame, ts: str = TS) -> DataFrame:
    """Gaps between neighbouring rows in hours, and whether they look hourly."""
    gaps = row_windowed(
        df.select(STATION, ts), lambda w: {"gap": hours_between(F.col(ts), F.lag(ts).over(w))}, before=1, order=[ts]
    )
    out = gaps.groupBy(STATION).agg(
        F.count("*").alias("rows"),
        F.avg("gap").alias("mean_gap"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
    )
    steady = F.col("mean_gap").between(*GAP_MEAN) & (F.col("min_gap") >= GAP_MIN) & (F.col("max_gap") <= GAP_MAX)
    return out.withColumn("hourly", F.coalesce(steady, F.lit(False)))


def freshness(df: DataFrame, now, ts: str = TS, ingested: str = "ingestion_timestamp") -> DataFrame:
    """Age of the newest actual reading of each station, with words and alerts."""
    at = instant(df, now, ts)
    past = df.where(F.col(ts) <= at)
    newest = past.groupBy(STATION).agg(F.max(F.struct(F.col(ts), F.col(ingested))).alias("_n"))
    age = hours_between(at, F.coalesce(F.col(f"_n.{ingested}"), F.col(f"_n.{ts}")))
    return newest.select(
        STATION,
        F.col(f"_n.{ts}").alias("measured_at"),
        F.col(f"_n.{ingested}").alias("ingested_at"),
        age.alias("age_hours"),
        age_label(age).alias("age_label"),
        (age > STALE_HOURS).alias("stale"),
        (age > SEVERE_HOURS).alias("severe"),
    )


def constituents(latest: DataFrame, named: list[tuple[str, str, str]]) -> DataFrame:
    """One row per pollutant present in the current row, with name and unit."""
    items = F.array(
        *[
            F.struct(F.lit(label).alias("constituent"), clean(F.col(key)).alias("value"), F.lit(unit).alias("unit"))
            for key, label, unit in named
        ]
    )
    return latest.select(STATION, F.inline(items)).where(F.col("value").isNotNull())
