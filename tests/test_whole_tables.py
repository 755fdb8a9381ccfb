"""Current and newest rows of whole tables, and their fallback."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as driver
from airspark import fixtures as fx
from airspark.sources import payload, store
from tools.check import rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["pick_current_whole", "latest_actual_whole"])
def test_all_rows_are_used(spark, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    got = driver.queries()[name](spark, SF)
    want = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
    assert {r[0] for r in got.select("station_id").collect()} == {r[0] for r in fx.observations(spark, SF).select("station_id").distinct().collect()}
    flag = "is_forecast" if "is_forecast" in names else "is_actual"
    assert not got.where((~got[flag] if flag == "is_forecast" else got[flag]) & (got.station_id % 2 == 1)).isEmpty()


def test_a_station_that_starts_later_falls_back(spark):
    obs = fx.observations(spark, SF).drop("station_id", "ts").limit(1)
    times = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 5)), (2, datetime(2024, 1, 4)), (2, datetime(2024, 1, 6))], "station_id int, ts timestamp_ntz")
    table = times.crossJoin(obs)
    now = "2024-01-03 00:00:00"
    assert {(r["station_id"], r["ts"].day, r["is_forecast"]) for r in payload.pick_current(table, now).collect()} == {(1, 1, False), (2, 4, True)}
    assert {(r["station_id"], r["ts"].day, r["is_actual"]) for r in store.newest_actual(table, now).collect()} == {(1, 1, True), (2, 6, False)}
