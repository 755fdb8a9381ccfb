"""Hourly payloads: JSON objects of parallel arrays, one per station and request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airspark.functions.numbers import coerce
from airspark.functions.timefn import instant, micros, naive_utc
from airspark.schema import PAYLOAD, PAYLOAD_NAMES, POLLUTANTS, STATION, TS


def parse_payload(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """One row per entry of ``hourly.time``.

    A shorter series is padded with NULL and a longer one cut; a payload without
    times gives no rows; values that are not numbers become NULL.
    """
    keep = [STATION] if keep is None else keep
    at = df.select(*keep, F.from_json(payload, PAYLOAD).alias("_p")).select(
        *keep, "_p", F.posexplode("_p.hourly.time").alias("_i", "_t")
    )
    values = {name: coerce(F.get(F.col(f"_p.hourly.{api}"), F.col("_i"))) for api, name in PAYLOAD_NAMES.items()}
    return at.select(*keep, naive_utc(F.col("_t")).alias(TS), *[values[p].alias(p) for p in POLLUTANTS])


def _well_formed(hourly: Column) -> Column:
    times = F.size(hourly["time"])
    same = [F.coalesce(F.size(hourly[n]) == times, F.lit(False)) for n in PAYLOAD_NAMES]
    return reduce(lambda a, b: a & b, same, hourly["time"].isNotNull())


def parse_payload_strict(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """As ``parse_payload``, but the job fails on a missing or uneven series."""
    hourly = F.from_json(payload, PAYLOAD)["hourly"]
    checked = F.when(_well_formed(hourly), F.col(payload)).otherwise(
        F.raise_error(F.lit("payload with a missing series or uneven lengths"))
    )
    return parse_payload(df.withColumn(payload, checked), payload, keep)


def to_payload(df: DataFrame, by: list[str]) -> DataFrame:
    """The inverse: one JSON payload per group of ``by``, entries in time order.

    Groups are to be short, such as one station and day.
    """
    api = {name: a for a, name in PAYLOAD_NAMES.items()}
    entries = F.array_sort(F.collect_list(F.struct(F.col(TS), *[F.col(p) for p in POLLUTANTS])))
    rows = df.groupBy(*by).agg(entries.alias("_rows"))
    series = [F.transform("_rows", lambda r: F.date_format(r[TS], "yyyy-MM-dd'T'HH:mm")).alias("time")]
    series += [F.col(f"_rows.{p}").alias(api[p]) for p in POLLUTANTS]
    return rows.select(*by, F.struct(*series).alias("hourly"))


def payload_json(nested: DataFrame, by: list[str]) -> DataFrame:
    text = F.to_json(F.struct("hourly"), {"ignoreNullFields": "false"})
    return nested.select(*by, text.alias("payload"))


def pick_current(df: DataFrame, now, ts: str = TS) -> DataFrame:
    """Per station the newest row not after ``now``'s hour, else the next one after it."""
    hour = F.date_trunc("hour", instant(df, now, ts)).cast(df.schema[ts].dataType)
    past = F.col(ts) <= hour
    closeness = F.when(past, micros(F.col(ts))).otherwise(-micros(F.col(ts)))
    rest = [F.col(c) for c in df.columns if c != STATION]
    best = df.groupBy(STATION).agg(F.max(F.struct(past.alias("past"), closeness.alias("close"), *rest)).alias("_b"))
    return best.select(STATION, *[F.col(f"_b.{c}") for c in df.columns if c != STATION], (~F.col("_b.past")).alias("is_forecast"))


def chunk_windows(spans: DataFrame, start: str = "start", end: str = "end", days: int = 8) -> DataFrame:
    """Cut each row's date span into ranges of ``days`` days, both ends included."""
    begins = F.sequence(F.col(start), F.col(end), F.make_dt_interval(days=F.lit(days)))
    others = [c for c in spans.columns if c not in (start, end)]
    cut = spans.select(*others, F.col(end).alias("_end"), F.posexplode(begins).alias("chunk_id", "chunk_start"))
    last = F.least(F.date_add("chunk_start", days - 1), F.col("_end"))
    return cut.select(*others, "chunk_id", "chunk_start", last.alias("chunk_end"))
