"""Shared folders: only a session of one process may use a folder of its own; the hourly job parses once."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from airspark import session
from airspark.plans.jobs import hourly_ingest
from airspark.schema import FEATURE_TABLE
from airspark.sources.payload import parse_payload

NAMES = ["pm10", "pm2_5", "ozone", "nitrogen_dioxide", "sulphur_dioxide", "carbon_monoxide"]


@pytest.mark.parametrize("master,alone", [("local", True), ("local[*]", True), ("local[8, 2]", True), ("local-cluster[2,1,1024]", False), ("spark://a:1", False), ("yarn", False)])
def test_masters_of_one_process(master, alone):
    assert session.one_machine(master) is alone


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "local-cluster[2,1,1024]"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Elsewhere, "x")


def payloads(spark):
    hours = [f"2025-12-01T{h:02d}:00" for h in range(9, 12)]
    body = json.dumps({"hourly": {"time": hours, **{n: [10.0, 12.0, 15.0] for n in NAMES}}})
    return spark.createDataFrame([(1, body), (2, body)], "station_id int, payload string")


def test_the_hourly_job_reads_its_payloads_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = payloads(spark)
    history = parse_payload(rows).withColumn("aqi", F.lit(20))
    got = hourly_ingest(rows.mapInArrow(count, rows.schema), history, "2025-12-01 11:30:00")
    assert got.columns == FEATURE_TABLE.names
    found = {r.station_id: r for r in got.collect()}
    assert set(found) == {1, 2} and str(found[1]["ts"]) == "2025-12-01 11:00:00"
    assert seen.value == 2
