"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as driver  # noqa: E402
from tools.check import rows  # noqa: E402

SF = "/root/testdata/sf0.001"
# One query of each family; ``tools/check.py`` compares all of them.
CHOSEN = [
    "aqi_hourly", "aqi_resolved", "change_rate_asof", "change_rate_eps", "hourly_pattern", "weekly_pattern", "hour_extremes",
    "describe", "iqr_outliers", "histogram_overlay", "correlation_matrix", "trend_slope", "missing_report", "interval_check",
    "freshness", "align_schema", "drift_status", "drift_ks", "parse_payload", "pick_current", "chunk_windows", "latest_version",
    "last_points", "upsert", "hourly_ingest", "backfill_job", "features_full", "chrono_split", "serving_features",
    "mirror_forecast", "forecast_summary", "actual_t72", "pick_winner", "stationarity", "top_drivers", "stream_hourly",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = driver.queries()[name](spark, SF)
    want = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
