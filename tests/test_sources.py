"""Payload parsing, upsert, store and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F, types as T

from airspark.functions.aqi import aqi
from airspark.operators.features import time_parts
from airspark.operators.merge import upsert
from airspark.schema import FEATURE_TABLE, POLLUTANTS
from airspark.session import scratch_path
from airspark.sources import payload
from airspark.sources.store import FeatureStore, latest_version
from airspark.streaming import ingest

GOOD = {
    "hourly": {
        "time": ["2024-06-03T21:00", "2024-06-03T22:00"],
        "pm10": [61.0, 58.4], "pm2_5": [44.7, 41.2], "ozone": [72.5, 66.0],
        "nitrogen_dioxide": [23.8, 27.9], "sulphur_dioxide": [3.1, 2.9], "carbon_monoxide": [310.0, 342.5],
    }
}


def payloads(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "station_id int, payload string")


def changed(**series):
    return {"hourly": {**GOOD["hourly"], **series}}


def test_rows_and_columns(spark):
    df = payload.parse_payload(payloads(spark, GOOD))
    assert df.columns == ["station_id", "ts", *POLLUTANTS]
    last = df.orderBy(F.col("ts").desc()).first()
    assert (last.pm10, last.pm2_5, last.o3, last.no2, last.so2, last.co) == (58.4, 41.2, 66.0, 27.9, 2.9, 342.5)
    assert {t for n, t in df.dtypes if n in POLLUTANTS} == {"double"}


def test_ranges_and_time_parts(spark):
    for r in time_parts(payload.parse_payload(payloads(spark, GOOD))).collect():
        assert all(r[p] >= 0 for p in POLLUTANTS) and r.pm2_5 <= r.pm10 < 1000
        assert (r.hour, r.day, r.month) == (r.ts.hour, r.ts.day, r.ts.month)


@pytest.mark.parametrize("empty", [{}, {"hourly": {"time": []}}, {"hourly": {}}, "not json", "null"])
def test_payloads_without_times(spark, empty):
    assert payload.parse_payload(payloads(spark, empty)).count() == 0


def test_times_are_utc(spark):
    df = payload.parse_payload(payloads(spark, changed(time=["2025-12-01T10:00", "2025-12-01T10:00+02:00"])))
    assert sorted(str(r.ts) for r in df.collect()) == ["2025-12-01 08:00:00", "2025-12-01 10:00:00"]


def test_uneven_series(spark):
    df = payload.parse_payload(payloads(spark, changed(pm10=[1.0], ozone=[1.0, 2.0, 3.0], carbon_monoxide=["bad", 2]))).orderBy("ts")
    a, b = df.collect()
    assert (a.pm10, b.pm10) == (1.0, None) and (a.o3, b.o3) == (1.0, 2.0) and (a.co, b.co) == (None, 2.0)
    missing = {"hourly": {k: v for k, v in GOOD["hourly"].items() if k != "pm10"}}
    assert [r.pm10 for r in payload.parse_payload(payloads(spark, missing)).collect()] == [None, None]


@pytest.mark.parametrize("bad", [changed(pm10=[1.0]), {"hourly": {"time": ["2025-12-01T10:00"]}}, {}])
def test_strict_parsing_fails(spark, bad):
    with pytest.raises(Exception, match="missing series"):
        payload.parse_payload_strict(payloads(spark, bad)).collect()


def test_pick_current(spark):
    rows = [(1, "2024-01-01 09:00:00", 1.0), (1, "2024-01-01 10:00:00", 2.0), (1, "2024-01-01 11:00:00", 3.0), (2, "2024-01-01 12:00:00", 4.0), (2, "2024-01-01 13:00:00", 5.0)]
    df = spark.createDataFrame(rows, "station_id int, t string, pm2_5 double").select("station_id", F.col("t").cast("timestamp_ntz").alias("ts"), "pm2_5")
    got = {r.station_id: (r.pm2_5, r.is_forecast) for r in payload.pick_current(df, "2024-01-01 10:59:00").collect()}
    assert got == {1: (2.0, False), 2: (4.0, True)}


def observations(spark, *rows):
    df = spark.createDataFrame(rows, "station_id int, t string, pm2_5 double")
    return df.select("station_id", F.col("t").cast("timestamp_ntz").alias("ts"), "pm2_5")


def values(df):
    return {(r.station_id, str(r.ts)): r.pm2_5 for r in df.collect()}


def test_upsert(spark):
    stored = observations(spark, (1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 01:00:00", 2.0))
    batch = observations(spark, (1, "2024-01-01 01:00:00", 3.0), (1, "2024-01-01 01:00:00", 4.0), (2, "2024-01-01 01:00:00", 5.0))
    placed = batch.withColumn("pos", F.col("pm2_5"))
    once = upsert(stored, placed, "pos")
    assert values(once) == {(1, "2024-01-01 00:00:00"): 1.0, (1, "2024-01-01 01:00:00"): 4.0, (2, "2024-01-01 01:00:00"): 5.0}
    assert once.count() == 3 and values(upsert(once, placed, "pos")) == values(once)


def test_copies_of_one_key_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.lit(1).alias("station_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("pm2_5"), F.col("id").alias("pos"))
    out = upsert(rows.drop("pos").limit(0), rows, "pos")
    assert [r.pm2_5 for r in out.collect()] == [999.0]
    plan = out._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_store(spark):
    store = FeatureStore(spark, scratch_path(spark, "t")).init()
    assert store.read().count() == 0
    store.save(observations(spark, (1, "2024-01-31 23:00:00", 1.0), (1, "2024-02-01 00:00:00", 2.0)).withColumn("extra", F.lit(1)))
    store.save(observations(spark, (1, "2024-02-01 00:00:00", 9.0), (1, "2024-03-01 00:00:00", 3.0)))
    assert store.read().schema == FEATURE_TABLE or [f.name for f in store.read().schema] == FEATURE_TABLE.names
    assert values(store.read()) == {(1, "2024-01-31 23:00:00"): 1.0, (1, "2024-02-01 00:00:00"): 9.0, (1, "2024-03-01 00:00:00"): 3.0}
    some = store.read("2024-01-31 23:00:00", "2024-02-01 00:00:00", columns=["ts", "pm2_5"])
    assert some.count() == 2
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month_start" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert store.latest().first().pm2_5 == 3.0 and store.recent("2024-03-01 10:00:00").count() == 1
    wider = store.append_features(T.StructType([T.StructField("humidity", T.DoubleType()), T.StructField("AQI", T.IntegerType())]))
    assert wider.read().columns.count("humidity") == 1 and "AQI" not in wider.read().columns


def scan_of(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]


def test_columns_of_another_instance_stay(spark):
    root = scratch_path(spark, "two")
    wider = FeatureStore(spark, root).init().append_features(T.StructType([T.StructField("humidity", T.DoubleType())]))
    wider.save(observations(spark, (1, "2024-01-05 00:00:00", 1.0)).withColumn("humidity", F.lit(0.5)))
    FeatureStore(spark, root).save(observations(spark, (1, "2024-01-06 00:00:00", 2.0)))
    assert sorted((r.pm2_5, r.humidity) for r in FeatureStore(spark, root).read().collect()) == [(1.0, 0.5), (2.0, None)]


def test_reads_are_pruned_by_month_and_version(spark):
    store = FeatureStore(spark, scratch_path(spark, "pruned")).init()
    store.save(observations(spark, (1, "2024-01-05 00:00:00", 1.0), (1, "2024-03-05 00:00:00", 2.0)))
    months = store._stored().where(F.col("month_start").isin(["2024-03-01"]))
    assert all("month_start" in line.split("PartitionFilters")[1] for line in scan_of(months))
    path = scratch_path(spark, "versions")
    spark.range(4).select("id", (F.col("id") % 2).cast("int").alias("version")).write.partitionBy("version").parquet(path)
    newest = latest_version(spark.read.parquet(path))
    assert sorted(r.id for r in newest.collect()) == [1, 3]
    assert any("version" in line and "= 1" in line.split("PartitionFilters")[1].split("]")[0] for line in scan_of(newest))


def test_latest_version_default(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "x int, version int")
    assert sorted(r.x for r in latest_version(df).collect()) == [2, 3]
    assert latest_version(df.limit(0)).count() == 0


def test_stream_ingest_twice_gives_the_same_table(spark):
    folder, alerts = scratch_path(spark, "in"), scratch_path(spark, "alerts")
    rows = payloads(spark, GOOD, changed(pm2_5=[1.0, 2.0])).withColumn("sent_at", F.lit("2024-06-03 23:00:00").cast("timestamp_ntz"))
    rows.select("station_id", "sent_at", "payload").write.json(folder)
    store = FeatureStore(spark, scratch_path(spark, "s")).init()

    def run(state):
        job = ingest.ingest_payloads(ingest.payload_stream(spark, folder), store, scratch_path(spark, state), "2024-06-04 02:00:00", alerts)
        job.awaitTermination()
        return sorted(map(tuple, store.read().collect()))

    first = run("a")
    assert len(first) == 4 and run("b") == first
    expected = payload.parse_payload(payloads(spark, GOOD)).select(aqi().alias("aqi")).collect()
    assert {r.aqi for r in expected} == {r.aqi for r in store.read().where("station_id = 0").collect()}
    ages = spark.read.parquet(alerts)
    assert {(r.station_id, r.stale, r.severe) for r in ages.collect()} == {(0, True, False), (1, True, False)}
