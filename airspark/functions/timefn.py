"""Calendar and clock expressions. The session time zone is UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for range frames and time buckets."""
    return F.unix_micros(ts.cast("timestamp"))


def floor_div(value: Column, size: int) -> Column:
    """Exact floor of an integer quotient, also for microsecond counts."""
    return ((value - F.pmod(value, F.lit(size))) / F.lit(size)).cast("bigint")


def instant(df: DataFrame, value, ts: str = "ts") -> Column:
    """A literal instant of the same type as ``ts``, so filters push down."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast(df.schema[ts].dataType)


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(HOUR_US))


def add_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(hours=hours)


def naive_utc(text: Column) -> Column:
    """Timestamp text with or without an offset to UTC wall-clock time."""
    # An offset right after the minutes is not understood by the cast.
    seconds = F.regexp_replace(text, r"^(.{10}[T ]\d\d:\d\d)([+\-Z].*)$", "$1:00$2")
    return seconds.try_cast("timestamp").cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def clock_label(hour: Column) -> Column:
    """Twelve-hour label of an hour number, such as ``05 PM``."""
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    half = F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM"))
    return F.concat_ws(" ", F.lpad(twelve.cast("string"), 2, "0"), half)


def month_label(month: Column, pattern: str = "MMM") -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), pattern)


def age_label(hours: Column) -> Column:
    """Words for the age of a reading."""
    minutes = F.floor(hours * 60).cast("int")
    whole = F.floor(hours).cast("int")
    days = F.floor(hours / 24).cast("int")

    def unit(n, one, many):
        return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))

    return (
        F.when(hours.isNull(), F.lit(None).cast("string"))
        .when(hours < 0, F.lit("Forecast"))
        .when((hours < 1) & (minutes == 0), F.lit("< 1 min"))
        .when(hours < 1, unit(minutes, "min", "min"))
        .when(hours < 24, unit(whole, "hour", "hours"))
        .otherwise(unit(days, "day", "days"))
    )
