"""Forecasts that need no model, and what is said about a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airspark.functions.aqi import card_status, pm25_to_aqi
from airspark.functions.numbers import ratio
from airspark.functions.timefn import add_hours, hours_between, instant
from airspark.operators.series import last_rows
from airspark.plans.serving import recent_state
from airspark.schema import STATION, TS

HORIZON = 72
# Decay of the start gap, lowest value shown, and card hours.
DECAY, FLOOR = 0.8, 5.0
CARDS = ((24, "Tomorrow"), (48, "In 2 Days"), (72, "In 3 Days"))
TREND_HOURS = 168
GAP_HOURS = 4


def mirror_forecast(df: DataFrame, now, steps: int = HORIZON) -> DataFrame:
    """Replay the last 72 values of each station as the next ones.

    A shorter history is repeated from its start. The start gap fades out.
    """
    state = recent_state(df, now)
    n = F.size("hist")
    ends_with = F.try_element_at("hist", F.pmod(F.lit(HORIZON - 1), n) + 1)
    gap = F.col("pm2_5") - ends_with
    stored = F.col("aqi") if "aqi" in state.columns else F.lit(None).cast("int")
    current = F.coalesce(stored.cast("int"), pm25_to_aqi(F.col("pm2_5")))
    out = state.select(
        STATION,
        F.col(TS).alias("data_time"),
        current.alias("current_aqi"),
        "hist",
        gap.alias("_gap"),
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"),
    )
    base = F.try_element_at("hist", F.pmod(F.col("step") - 1, F.size("hist")) + 1)
    value = F.greatest(F.lit(FLOOR), base + F.col("_gap") * F.pow(F.lit(DECAY), F.col("step")))
    return out.select(
        STATION,
        "step",
        add_hours(F.col("data_time"), F.col("step")).alias(TS),
        value.alias("pm2_5"),
        pm25_to_aqi(value).alias("aqi"),
        "current_aqi",
        "data_time",
    )


def mirror_cards(forecast: DataFrame) -> DataFrame:
    title = F.lit(None).cast("string")
    for hour, label in CARDS:
        title = F.when(F.col("step") == hour, F.lit(label)).otherwise(title)
    return forecast.where(F.col("step").isin([h for h, _ in CARDS])).select(
        STATION, "step", title.alias("card"), "aqi", (F.col("aqi") - F.col("current_aqi")).alias("delta"),
        card_status(F.col("aqi")).alias("status"),
    )


def naive_forecast(df: DataFrame, steps: int) -> DataFrame:
    """The last value of each series for every step."""
    last = df.groupBy(STATION).agg(F.max(F.struct(TS, "pm2_5")).alias("_l"))
    return last.select(
        STATION, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.col("_l.pm2_5").alias("predicted")
    )


def trend_7d(df: DataFrame, now) -> DataFrame:
    """Chart rows: a week of history, the current point, and the forecast."""
    past = df.where(F.col(TS) <= instant(df, now))
    history = last_rows(past, TREND_HOURS).select(
        STATION, F.lit("history").alias("kind"), TS, pm25_to_aqi(F.col("pm2_5")).alias("aqi"), F.lit(False).alias("after_gap")
    )
    forecast = mirror_forecast(df, now)
    last = past.groupBy(STATION).agg(F.max(TS).alias("_last"))
    start = (
        forecast.where(F.col("step") == 1)
        .join(last, STATION)
        .select(
            STATION,
            F.lit("now").alias("kind"),
            F.col("data_time").alias(TS),
            F.col("current_aqi").alias("aqi"),
            (hours_between(F.col("data_time"), F.col("_last")) > GAP_HOURS).alias("after_gap"),
        )
    )
    ahead = forecast.select(STATION, F.lit("forecast").alias("kind"), TS, "aqi", F.lit(False).alias("after_gap"))
    return history.unionByName(start).unionByName(ahead)


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Direction, extremes and daily cycle of each station's forecast."""
    c = F.col
    out = forecast.groupBy(STATION).agg(
        F.min_by("aqi", "step").alias("first_aqi"),
        F.max_by("aqi", "step").alias("last_aqi"),
        F.min("aqi").alias("min_aqi"),
        F.max(F.struct("aqi", (-c("step")).alias("_s"))).alias("_top"),
        F.stddev_pop("aqi").alias("spread"),
    )
    peak = (-c("_top._s") - 1).cast("int")
    change = c("last_aqi") - c("first_aqi")
    return out.select(
        STATION,
        "first_aqi",
        "last_aqi",
        "min_aqi",
        c("_top.aqi").alias("max_aqi"),
        peak.alias("peak_index"),
        F.when(peak > 48, F.lit("in 3 days")).when(peak > 24, F.lit("in 2 days")).when(peak > 12, F.lit("tomorrow"))
        .otherwise(F.lit("in the next few hours")).alias("peak_time"),
        F.when(change > 10, F.lit("worsening")).when(change < -10, F.lit("improving")).otherwise(F.lit("stable")).alias("trend"),
        F.when(c("spread") > 15, F.lit("daily cycle")).otherwise(F.lit("flat")).alias("pattern"),
        "spread",
    )


def forecast_discrepancy(forecast: DataFrame) -> DataFrame:
    """Mean forecast against the current index; only a meaningful index is flagged."""
    out = forecast.groupBy(STATION, "current_aqi").agg(F.avg("aqi").alias("mean_forecast"))
    now = F.col("current_aqi")
    pct = ratio(F.abs(F.col("mean_forecast") - now), now + F.lit(1e-6)) * 100
    return out.withColumn("difference_pct", pct).withColumn("flagged", (F.col("difference_pct") > 50) & (now > 50))
