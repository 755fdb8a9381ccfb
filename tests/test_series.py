"""Blocked windows against pandas: gaps, long series, one hot station."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from airspark.functions.timefn import HOUR_US, DAY_US
from airspark.operators import changerate, features, series
from airspark.plans import evaluate


@pytest.fixture(scope="module")
def readings():
    """One long sparse station, one short, and one with bursts and long silences."""
    rng = np.random.default_rng(7)
    parts = []
    for station, n, gap in ((0, 900, 1), (1, 30, 1), (2, 260, 40)):
        hours = np.cumsum(rng.integers(1, gap + 2, n))
        parts.append(
            pd.DataFrame(
                {
                    "station_id": station,
                    "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"),
                    "pm2_5": np.where(rng.random(n) < 0.03, np.nan, rng.gamma(2.0, 20.0, n).round(2)),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, readings):
    rows = [(int(s), t.to_pydatetime(), None if np.isnan(v) else float(v)) for s, t, v in readings.itertuples(index=False)]
    return spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, pm2_5 double").repartition(5)


def frame(out, columns):
    pdf = out.select("station_id", "ts", *columns).toPandas()
    return pdf.sort_values(["station_id", "ts"]).reset_index(drop=True)


def same(got, want, columns):
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("block_rows", [72, 100, None])
def test_features_equal_pandas_however_series_are_cut(df, readings, block_rows):
    out = df
    for fn in (features.lag_features, features.diff_features, features.hour_profile, features.rolling_features, features.targets):
        out = fn(out, block_rows=block_rows)
    want = readings.sort_values(["station_id", "ts"]).reset_index(drop=True)
    g = want.groupby("station_id")["pm2_5"]
    for k in features.LAGS:
        want[f"pm2_5_lag{k}"] = g.shift(k)
    want["diff_1h"], want["diff_24h"] = g.diff(1), g.diff(24)
    want["diff_1h_acc"] = want.groupby("station_id")["diff_1h"].diff(1)
    want["recent_hour_avg"] = want[["pm2_5_lag24", "pm2_5_lag48", "pm2_5_lag72"]].mean(axis=1)
    want["pm2_5_rolling_mean_24h"] = g.transform(lambda s: s.rolling(24).mean())
    want["pm2_5_rolling_std_24h"] = g.transform(lambda s: s.rolling(24).std())
    want["pm2_5_next"], want["pm2_5_3day"] = g.shift(-1), g.shift(-72)
    columns = [c for c in want.columns if c not in ("station_id", "ts", "pm2_5")]
    same(frame(out, columns), want, columns)


def test_row_numbers_and_totals(df, readings):
    got = frame(series.numbered(df), ["rn", "rn_total"])
    want = readings.sort_values(["station_id", "ts"]).reset_index(drop=True)
    assert got["rn"].tolist() == (want.groupby("station_id").cumcount() + 1).tolist()
    assert got["rn_total"].tolist() == want.groupby("station_id")["ts"].transform("count").tolist()


def test_numbering_twice_replaces_the_first(df):
    again = series.numbered(series.numbered(df).where("station_id = 0"))
    assert again.columns.count("rn") == 1


def test_block_must_hold_the_frame(df):
    with pytest.raises(ValueError):
        features.lag_features(df, block_rows=10)


@pytest.mark.parametrize("slice_us", [3 * HOUR_US, DAY_US, 64 * DAY_US])
def test_time_frames_across_cuts(df, readings, slice_us):
    def build(w):
        return {"n": F.count("*").over(w.rangeBetween(-2 * HOUR_US, -1)), "m": F.count("*").over(w.rangeBetween(0, 3 * HOUR_US))}

    got = frame(series.range_windowed(df, build, 2 * HOUR_US, 3 * HOUR_US, slice_us=slice_us), ["n", "m"])
    want = []
    for s, t, _ in readings.sort_values(["station_id", "ts"]).itertuples(index=False):
        ages = (t - readings.loc[readings.station_id == s, "ts"]).dt.total_seconds() / 3600
        want.append((int(((ages > 0) & (ages <= 2)).sum()), int(((ages <= 0) & (ages >= -3)).sum())))
    assert list(zip(got["n"], got["m"])) == want


def test_no_shuffle_key_is_the_station_alone(df):
    plan = features.lag_features(df)._jdf.queryExecution().toString()
    assert "specifiedwindowframe(RowFrame, -1, -1)" in plan
    lag_window = next(line for line in plan.splitlines() if "lag(pm2_5" in line and "Window" in line)
    assert "_block" in lag_window


def test_change_rate_bounds(spark):
    rows = [(1, "2024-01-01 00:00:00", 50), (1, "2024-01-01 02:00:00", 100), (1, "2024-01-01 04:00:01", 100),
            (2, "2024-01-01 00:00:00", 0), (2, "2024-01-01 01:00:00", 10), (2, "2024-01-01 02:00:00", 0), (2, "2024-01-01 03:00:00", None)]
    df = spark.createDataFrame(rows, "station_id int, t string, aqi int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = [r[0] for r in changerate.change_rate_asof(df).orderBy("station_id", "ts").select("aqi_change_rate").collect()]
    # Exactly two hours counts, a second more does not; zero before or now gives 0.
    assert got == [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    band = [r[0] for r in changerate.change_rate_band(df).orderBy("station_id", "ts").select("aqi_change_rate").collect()]
    assert band == [0.0] * 7


def test_actual_ahead_keeps_a_found_missing_value(spark):
    rows = [(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-04 00:00:00", None), (1, "2024-01-02 00:00:00", 7.0)]
    df = spark.createDataFrame(rows, "station_id int, t string, pm2_5 double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {str(r.ts): r.actual_t72 for r in evaluate.actual_ahead(df).collect()}
    assert got == {"2024-01-01 00:00:00": None, "2024-01-02 00:00:00": 7.0, "2024-01-04 00:00:00": None}


def test_appending_later_rows_leaves_features_alone(df):
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    early = frame(features.lag_features(df.where(F.col("ts") < cut), block_rows=80), ["pm2_5_lag72", "pm2_5_lag1"])
    whole = frame(features.lag_features(df, block_rows=80).where(F.col("ts") < cut), ["pm2_5_lag72", "pm2_5_lag1"])
    pd.testing.assert_frame_equal(early, whole)
