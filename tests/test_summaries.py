"""Quantiles, drift and summaries against numpy and pandas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airspark.operators import drift, eda
from airspark.operators.quantiles import quantiles, value_bucket


def table(spark, columns: dict[int, dict[str, list]]):
    rows, names = [], list(next(iter(columns.values())))
    for station, values in columns.items():
        rows += [(station, *[None if v is None else float(v) for v in row]) for row in zip(*values.values())]
    return spark.createDataFrame(rows, "station_id int, " + ", ".join(f"{n} double" for n in names)).repartition(4)


CASES = {
    "gamma": np.random.default_rng(1).gamma(2, 20, 500).round(2),
    "heavy_tail": np.concatenate([np.random.default_rng(2).random(300), [1e12, -1e12]]),
    "narrow": 1013 + np.random.default_rng(3).random(400) / 1000,
    "negative": -np.random.default_rng(4).gamma(2, 5, 333),
    "constant": np.full(50, 7.25),
    "few": np.array([3.0, 1.0]),
    "single": np.array([4.5]),
    "repeats": np.random.default_rng(5).integers(0, 4, 1000).astype(float),
}


def test_quantiles_equal_numpy(spark):
    rows = [(i, float(v)) for i, values in enumerate(CASES.values()) for v in values]
    df = spark.createDataFrame(rows, "station_id int, x double").repartition(6)
    wanted = {"p00": 0.0, "p05": 0.05, "q25": 0.25, "q50": 0.5, "q95": 0.95, "p100": 1.0}
    got = {r.station_id: r for r in quantiles(df, ["x"], wanted).collect()}
    for i, values in enumerate(CASES.values()):
        assert got[i].n == len(values)
        for name, p in wanted.items():
            assert got[i][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_buckets_follow_the_order_of_values(spark):
    values = sorted([*CASES["gamma"], *CASES["negative"], *CASES["heavy_tail"], 0.0, -0.0, 1e-300])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    buckets = [r[0] for r in df.orderBy("i").select(value_bucket(F.col("x"))).collect()]
    assert buckets == sorted(buckets)


def test_correlation_of_a_constant_and_of_gaps(spark):
    df = table(spark, {1: {"a": [1, 2, 3, None, 5], "b": [2, 4, 7, 8, None], "c": [0.1] * 5}})
    got = {(r.a, r.b): r.r for r in eda.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "a")] == pytest.approx(1.0)
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert got[("a", "c")] is None and got[("c", "c")] is None


def test_skewness_needs_three_values_and_spread(spark):
    df = table(spark, {1: {"a": [1, 2, 10]}, 2: {"a": [5, 5, 5]}, 3: {"a": [1, 2, None]}})
    got = {r.station_id: r.skew for r in eda.distribution_shape(df, ["a"]).collect()}
    import pandas as pd

    assert got[1] == pytest.approx(pd.Series([1, 2, 10]).skew())
    assert got[2] is None and got[3] is None


def test_drift_edges(spark):
    base = table(spark, {1: {"x": [2] * 20}, 2: {"x": [0] * 20}, 3: {"x": [1, 2, 3, 4]}, 4: {"x": [1, 2]}})
    now = table(spark, {1: {"x": [2] * 5}, 2: {"x": [1] * 5}, 3: {"x": [None, None]}})
    got = {r.station_id: r for r in drift.drift_metrics(base, now, ["x"]).collect()}
    assert set(got) == {1, 2}  # an empty current sample gives no row
    assert got[1].drift is False and got[1].outside_share == 0.0
    assert got[2].drift is True and got[2].outside_share == 1.0


def test_ks_equals_numpy(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(0, 1, 200).round(1), rng.normal(0.4, 1, 90).round(1)
    df_a, df_b = table(spark, {1: {"x": list(a)}}), table(spark, {1: {"x": list(b)}})
    got = drift.drift_ks(df_a, df_b, ["x"]).first()
    points = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert got.ks == pytest.approx(want) and (got.n_base, got.n_current) == (200, 90)


def test_arg_max_ties_go_to_the_smaller_key(spark):
    rows = [(1, 5, 2.0), (1, 3, 2.0), (1, 9, 1.0), (1, 11, 1.0)]
    df = spark.createDataFrame(rows, "station_id int, hour int, pm2_5 double")
    got = eda.hour_extremes(df, ["pm2_5"]).first()
    assert (got.peak_hour, got.low_hour) == (3, 9)


def test_histogram_closes_the_last_bin(spark):
    df = table(spark, {1: {"x": [0, 1, 2, 10]}, 2: {"x": [4, 4, 4, 4]}})
    got = {(r.station_id, r.bin): r["count"] for r in eda.histogram(df, ["x"], bins=5).collect()}
    assert got == {(1, 0): 2, (1, 1): 1, (1, 4): 1, (2, 0): 4}
