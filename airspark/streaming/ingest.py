"""Incremental ingest of payload files, and hourly means of a stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airspark.functions.aqi import aqi
from airspark.operators.changerate import change_rate_asof
from airspark.operators.features import time_parts
from airspark.operators.merge import keep_last, upsert
from airspark.operators.quality import freshness
from airspark.schema import STATION, TS
from airspark.session import written
from airspark.sources.payload import parse_payload
from airspark.sources.store import FeatureStore

ENVELOPE = "station_id int, sent_at timestamp_ntz, payload string"


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of one JSON envelope per line: station, send time, payload text."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def distinct_envelopes(stream: DataFrame, within: str) -> DataFrame:
    """Each envelope once (station, send time and content), also when it is delivered again in a later batch.

    The state holds a key until the watermark, ``within`` behind the newest send time, has
    passed it. What arrives later than that is left out, so ``within`` must cover the
    longest delay between sending and delivery.
    """
    # Watermarks need an instant; the session's zone is UTC.
    marked = stream.withColumns({"_sent": F.col("sent_at").cast("timestamp"), "_content": F.xxhash64("payload")})
    once = marked.withWatermark("_sent", within).dropDuplicatesWithinWatermark([STATION, "sent_at", "_content"])
    return once.drop("_sent", "_content")


def ingest_payloads(
    stream: DataFrame,
    store: FeatureStore,
    checkpoint: str,
    now: str | None = None,
    alerts: str | None = None,
    repeats_within: str | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch into the store; run until the folder is worked off.

    With ``repeats_within``, envelopes that were delivered before are left out first.

    A batch that is delivered again writes the same rows again. Of repeats within
    a batch the one sent last wins, also when it comes late. With ``alerts`` the
    age of each station in the batch is appended there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = parse_payload(batch, keep=[STATION, "sent_at"])
        newest = keep_last(rows, ["sent_at"]).join(
            rows.groupBy(STATION, TS).agg(F.max("sent_at").alias("ingestion_timestamp")), [STATION, TS]
        )
        ready = written(time_parts(newest).withColumn("aqi", aqi()), "arrived")
        span = ready.agg(F.min(TS).alias("first"), F.max(TS).alias("last")).first()  # two scalars
        if span["first"] is None:
            return
        # The change rate looks back two hours, over what is stored and what arrived.
        past = store.read(span["first"] - timedelta(hours=2), span["last"], columns=[STATION, TS, "aqi"])
        both = upsert(past, ready.select(STATION, TS, "aqi"))
        rates = change_rate_asof(both).select(STATION, TS, "aqi_change_rate")
        store.save(ready.join(rates, [STATION, TS]))
        if alerts is not None:
            # A station's newest row is in the batch, unless the batch is late: then it is stored
            # after the batch's first hour.
            touched = ready.select(STATION).distinct()
            at = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
            known = store.read(start=span["first"], columns=[STATION, TS, "ingestion_timestamp"]).join(touched, STATION, "left_semi")
            aged = freshness(known, at).withColumn("batch_id", F.lit(batch_id))
            # One folder per batch: writing it twice leaves one copy.
            aged.write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")

    source = distinct_envelopes(stream, repeats_within) if repeats_within else stream
    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The last age report of every station from all batches so far."""
    return keep_last(spark.read.parquet(folder).drop("batch"), ["batch_id"], [STATION])


def hourly_means(stream: DataFrame, value: str = "value", ts: str = TS, late: str = "2 hours") -> DataFrame:
    """Mean per station and hour; state of closed hours is dropped after ``late``."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(STATION, F.window(ts, "1 hour"))
        .agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))
        .select(STATION, F.col("window.start").alias("hour_start"), "mean_value", "n")
    )


def write_updates(means: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the changed hours of each micro-batch, tagged with its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        means.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, folder: str) -> DataFrame:
    """The current value of each hour from all updates written so far."""
    return keep_last(spark.read.parquet(folder), ["batch"], [STATION, "hour_start"])
