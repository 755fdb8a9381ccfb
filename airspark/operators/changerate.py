"""Change rates. Four definitions are in use; each has its own name here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airspark.functions.numbers import ratio
from airspark.functions.timefn import DAY_US, HOUR_US, floor_div, micros
from airspark.operators.series import range_windowed, row_windowed
from airspark.schema import STATION, TS

EPSILON = 1e-6
CHUNK_DAYS = 8


def _relative(now: Column, previous: Column) -> Column:
    usable = (now != 0) & (previous > 0)
    return F.when(usable, ratio((now - previous).cast("double"), previous.cast("double"))).otherwise(F.lit(0.0))


def _asof(df: DataFrame, oldest_us: int, newest_us: int, value: str, name: str) -> DataFrame:
    # The newest row of the band counts even when its value is missing.
    found = f"_{name}_row"

    def build(w):
        band = w.rangeBetween(-oldest_us, -newest_us)
        return {found: F.last(F.struct(F.col(value).alias("v"))).over(band)}

    out = range_windowed(df, build, before_us=oldest_us)
    return out.withColumn(f"prev_{value}", F.col(f"{found}.v")).withColumn(
        name, _relative(F.col(value), F.col(f"prev_{value}"))
    ).drop(found)


def change_rate_asof(df: DataFrame, value: str = "aqi", name: str = "aqi_change_rate") -> DataFrame:
    """Against the newest row of the two hours before."""
    return _asof(df, 2 * HOUR_US, 1, value, name)


def change_rate_band(df: DataFrame, value: str = "aqi", name: str = "aqi_change_rate") -> DataFrame:
    """Against the newest row between 90 and 30 minutes before."""
    return _asof(df, 3 * HOUR_US // 2, HOUR_US // 2, value, name)


def change_rate_rows(df: DataFrame, value: str = "aqi", name: str = "aqi_change_rate", **how) -> DataFrame:
    """Against the row before, whatever its age; 0 where undefined."""

    def build(w):
        previous = F.lag(value).over(w)
        return {name: F.coalesce(ratio((F.col(value) - previous).cast("double"), previous.cast("double")), F.lit(0.0))}

    return row_windowed(df, build, before=1, **how)


def chunk_id(start: Column, ts: str = TS, days: int = CHUNK_DAYS) -> Column:
    return floor_div(micros(F.col(ts)) - micros(start), days * DAY_US).cast("int")


def change_rate_eps(df: DataFrame, chunk: str = "chunk_id", value: str = "pm2_5", name: str = "aqi_change_rate") -> DataFrame:
    """Against the row before in the same chunk, with a small constant added below."""
    w = Window.partitionBy(STATION, chunk).orderBy(TS)
    previous = F.lag(value).over(w)
    rate = ratio(F.col(value) - previous, previous + F.lit(EPSILON))
    return df.withColumn(name, F.coalesce(rate, F.lit(0.0)))
