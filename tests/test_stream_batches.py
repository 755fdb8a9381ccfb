"""Streams whose files outnumber those of a batch."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from airspark.catalog import load
from airspark.session import scratch_path

SMALL = "/root/testdata/sf0.01"


def test_resent_days_never_share_a_batch_with_first_ones(spark):
    # Twenty stations fill three files, one more than a batch takes.
    folder = scratch_path(spark, "more-stations")
    events = spark.read.parquet(f"{SMALL}/events.parquet").where(F.dayofmonth("ts") < 8)
    more = events.withColumn("user_id", F.col("user_id") + 160).unionByName(events)
    more.coalesce(1).write.parquet(f"{folder}/events.parquet")
    queries, sql = load()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    found = con.execute(f"select station_id, ts, aqi_change_rate from ({sql['stream_ingest']})").fetchall()
    got = queries["stream_ingest"](spark, folder).select("station_id", "ts", "aqi_change_rate").collect()
    assert sorted(map(tuple, got)) == sorted(found)
