"""Index, clock and change-rate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspark import fixtures as fx
from airspark.catalog.registry import q6, query, rounded
from airspark.catalog.sql import OBS, TIMED, WITH_AQI, aqi_sql, part_sql, pm_aqi_sql
from airspark.functions import aqi as index
from airspark.functions.timefn import instant
from airspark.operators import changerate, features
from airspark.schema import POLLUTANTS


@query(f"with {OBS} select station_id, ts, {aqi_sql()} aqi, case when {aqi_sql()} <= 50 then 'Good' when {aqi_sql()} <= 100 then 'Moderate'"
       f" when {aqi_sql()} <= 150 then 'Unhealthy for Sensitive Groups' when {aqi_sql()} <= 200 then 'Unhealthy'"
       f" when {aqi_sql()} <= 300 then 'Very Unhealthy' else 'Hazardous' end category from obs")
def aqi_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fx.observations(spark, sf_dir)
    return obs.select("station_id", "ts", index.aqi().alias("aqi")).withColumn("category", index.category(F.col("aqi")))


@query(f"with {OBS} select station_id, ts, " + ", ".join(f"{part_sql(p)} i_{p}" for p in POLLUTANTS) + " from obs")
def aqi_subindex(spark, sf_dir):
    parts = [index.pollutant_index(p).alias(f"i_{p}") for p in POLLUTANTS]
    return fx.observations(spark, sf_dir).select("station_id", "ts", *parts)


@query(f"with {OBS} select station_id, ts, {aqi_sql(('pm2_5', 'pm10'))} aqi from obs")
def aqi_pm_only(spark, sf_dir):
    obs = fx.observations(spark, sf_dir)
    return obs.select("station_id", "ts", index.aqi_particles().alias("aqi"))


@query(f"with {OBS} select station_id, ts, {pm_aqi_sql('pm2_5')} aqi from obs")
def pm25_to_aqi(spark, sf_dir):
    return fx.observations(spark, sf_dir).select("station_id", "ts", index.pm25_to_aqi(F.col("pm2_5")).alias("aqi"))


@query(f"with {WITH_AQI} select category, count(*) n, min(aqi) min_aqi, max(aqi) max_aqi from (select aqi, case when aqi <= 50 then 'Good'"
       " when aqi <= 100 then 'Moderate' when aqi <= 150 then 'Unhealthy for Sensitive Groups' when aqi <= 200 then 'Unhealthy'"
       " when aqi <= 300 then 'Very Unhealthy' else 'Hazardous' end category from a) group by 1")
def aqi_category(spark, sf_dir):
    return (
        fx.with_aqi(spark, sf_dir)
        .groupBy(index.category(F.col("aqi")).alias("category"))
        .agg(F.count("*").alias("n"), F.min("aqi").alias("min_aqi"), F.max("aqi").alias("max_aqi"))
    )


@query(f"with {WITH_AQI} select station_id, ts, coalesce(stored, {aqi_sql()}) aqi, coalesce(stored, {pm_aqi_sql('pm2_5')}) aqi_pm"
       " from (select *, case when hour % 3 <> 0 then aqi end stored from a)")
def aqi_resolved(spark, sf_dir):
    stored = F.when(F.col("hour") % 3 != 0, F.col("aqi"))
    return fx.with_aqi(spark, sf_dir).select(
        "station_id",
        "ts",
        index.resolved(stored).alias("aqi"),
        F.coalesce(stored, index.pm25_to_aqi(F.col("pm2_5"))).alias("aqi_pm"),
    )


@query(f"with {TIMED} select station_id, ts, hour, day, month from timed")
def time_parts(spark, sf_dir):
    return fx.with_time(spark, sf_dir).select("station_id", "ts", "hour", "day", "month")


@query(f"with {TIMED} select station_id, ts, hour hour_raw, {q6('sin(2 * pi() * hour / 24)')} hour_sin, {q6('cos(2 * pi() * hour / 24)')} hour_cos,"
       f" {q6('sin(2 * pi() * month / 12)')} month_sin, {q6('cos(2 * pi() * month / 12)')} month_cos from timed")
def cyclical_time(spark, sf_dir):
    names = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
    out = features.cyclical_time(fx.with_time(spark, sf_dir))
    return rounded(out.select("station_id", "ts", "hour_raw", *names), *names)


@query(f"with {OBS} select station_id, ts, cast(isodow(ts) >= 6 as int) is_weekend from obs")
def weekend_flag(spark, sf_dir):
    return features.weekend_flag(fx.observations(spark, sf_dir)).select("station_id", "ts", "is_weekend")


_RATE = "case when aqi = 0 or prev_aqi is null or prev_aqi <= 0 then 0.0 else (aqi - prev_aqi)::double / prev_aqi end"


def _band_sql(oldest: str, newest: str) -> str:
    return (
        f"with {WITH_AQI}, p as (select *, last(aqi) over (partition by station_id order by ts range between"
        f" interval '{oldest}' preceding and interval '{newest}' preceding) prev_aqi from a)"
        f" select station_id, ts, aqi, prev_aqi, {q6(_RATE)} aqi_change_rate from p"
    )


@query(_band_sql("7200000000 microseconds", "1 microseconds"))
def change_rate_asof(spark, sf_dir):
    out = changerate.change_rate_asof(fx.with_aqi(spark, sf_dir))
    return rounded(out.select("station_id", "ts", "aqi", "prev_aqi", "aqi_change_rate"), "aqi_change_rate")


@query(_band_sql("90 minutes", "30 minutes"))
def change_rate_band(spark, sf_dir):
    out = changerate.change_rate_band(fx.with_aqi(spark, sf_dir))
    return rounded(out.select("station_id", "ts", "aqi", "prev_aqi", "aqi_change_rate"), "aqi_change_rate")


@query(f"with {OBS}, a as (select *, {aqi_sql(('pm2_5', 'pm10'))} aqi from obs),"
       " p as (select *, lag(aqi) over (partition by station_id order by ts) prev from a)"
       f" select station_id, ts, aqi, {q6('coalesce((aqi - prev)::double / nullif(prev, 0), 0)')} aqi_change_rate from p")
def change_rate_rows(spark, sf_dir):
    obs = fx.observations(spark, sf_dir).withColumn("aqi", index.aqi_particles())
    out = changerate.change_rate_rows(obs.select("station_id", "ts", "aqi"))
    return rounded(out, "aqi_change_rate")


CHUNK_SQL = f"cast(floor(date_diff('day', timestamp '{fx.START}', ts) / 8) as int)"


@query(f"with {OBS}, c as (select *, {CHUNK_SQL} chunk_id from obs),"
       " p as (select *, lag(pm2_5) over (partition by station_id, chunk_id order by ts) prev from c)"
       f" select station_id, chunk_id, ts, {q6('coalesce((pm2_5 - prev) / nullif(prev + 1e-6, 0), 0)')} aqi_change_rate from p")
def change_rate_eps(spark, sf_dir):
    obs = fx.observations(spark, sf_dir)
    chunked = obs.withColumn("chunk_id", changerate.chunk_id(instant(obs, fx.START)))
    out = changerate.change_rate_eps(chunked)
    return rounded(out.select("station_id", "chunk_id", "ts", "aqi_change_rate"), "aqi_change_rate")
