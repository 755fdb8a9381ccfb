"""Ingest and backfill. A backfill is one lazy plan; the hourly ingest writes its current rows first."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from airspark.functions.aqi import aqi, aqi_particles
from airspark.functions.timefn import instant
from airspark.operators.changerate import change_rate_asof, change_rate_eps, change_rate_rows, chunk_id
from airspark.operators.features import time_parts
from airspark.operators.quality import align_schema
from airspark.schema import FEATURE_TABLE, STATION, TS
from airspark.session import written
from airspark.sources.payload import parse_payload, pick_current
from airspark.sources.store import FeatureStore, time_range


def hourly_ingest(payloads: DataFrame, history: DataFrame | FeatureStore, now) -> DataFrame:
    """The current row of each station, ready to store.

    ``history`` is a store or holds stored rows with ``aqi``. The change rate looks back
    two hours; the earliest and latest current row bound what is read of it.
    """
    # One row per station, written: the payloads are parsed once for the span, the history and the result.
    rows = written(pick_current(parse_payload(payloads), now).drop("is_forecast"), "current")
    current = time_parts(rows).withColumns({"aqi": aqi(), "ingestion_timestamp": instant(rows, now)})
    span = rows.agg(F.min(TS).alias("first"), F.max(TS).alias("last")).first()  # two scalars
    if span["first"] is not None:
        first, last = span["first"] - timedelta(hours=2), span["last"]
        history = history.read(first, last) if isinstance(history, FeatureStore) else time_range(history, first, last)
    elif isinstance(history, FeatureStore):
        history = history.read().limit(0)
    reach = current.select(STATION, F.col(TS).alias("_now"))
    past = history.join(reach, STATION).where(
        (F.col(TS) >= F.col("_now") - F.expr("interval 2 hours")) & (F.col(TS) < F.col("_now"))
    )
    both = past.select(STATION, TS, "aqi").withColumn("_new", F.lit(False)).unionByName(
        current.select(STATION, TS, "aqi").withColumn("_new", F.lit(True))
    )
    rated = change_rate_asof(both).where("_new").select(STATION, TS, "aqi_change_rate")
    return align_schema(current.join(rated, [STATION, TS]), FEATURE_TABLE)


def backfill(payloads: DataFrame, start, now, pollutants: str = "all") -> DataFrame:
    """All chunks of a backfill at once.

    ``"all"`` uses every pollutant and the change of PM2.5 within a chunk;
    ``"particles"`` uses the two particle measures and the change of the index.
    """
    rows = parse_payload(payloads)
    timed = time_parts(rows).withColumn("ingestion_timestamp", instant(rows, now))
    if pollutants == "particles":
        rated = change_rate_rows(timed.withColumn("aqi", aqi_particles()))
    else:
        chunked = timed.withColumns({"aqi": aqi(), "chunk_id": chunk_id(instant(timed, start))})
        rated = change_rate_eps(chunked)
    return align_schema(rated, FEATURE_TABLE)
