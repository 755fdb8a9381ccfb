"""Observations derived from the driver's ``events`` table.

Sixteen users stand for one station, and their events of one hour for one
observation, so both the number of stations and the number of rows grow with
the table. Sums are exact decimals: the result does not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airspark.functions.aqi import aqi
from airspark.functions.timefn import instant
from airspark.operators.features import time_parts
from airspark.schema import STATION, TS
from airspark.session import prepare

USERS_PER_STATION = 16
NOW = "2024-01-30 12:00:00"
RECENT_FROM = "2024-01-24 00:00:00"
START = "2024-01-01 00:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/events.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.col("value").cast("decimal(18,2)")
    total = F.sum(exact).cast("double")
    return (
        events(spark, sf_dir)
        .groupBy(
            F.floor(F.col("user_id") / USERS_PER_STATION).cast("int").alias(STATION),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias(TS),
        )
        .agg(
            (total / F.count("*")).alias("pm2_5"),
            F.max(F.when(F.col("event_type") != "error", F.col("value"))).alias("pm10"),
            total.alias("o3"),
            F.sum(F.when(F.col("event_type") != "signup", exact)).cast("double").alias("no2"),
            F.min("value").alias("so2"),
            (F.lit(100.0) * total / F.count("*")).alias("co"),
        )
    )


def with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_parts(observations(spark, sf_dir))


def with_aqi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_time(spark, sf_dir).withColumn("aqi", aqi())


def actual(df: DataFrame) -> DataFrame:
    return df.where(F.col(TS) <= instant(df, NOW))


def split_recent(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Baseline rows and the rows of the last week."""
    cut = instant(df, RECENT_FROM)
    return df.where(F.col(TS) < cut), df.where(F.col(TS) >= cut)


def is_baseline(df: DataFrame) -> Column:
    return F.col(TS) < instant(df, RECENT_FROM)
