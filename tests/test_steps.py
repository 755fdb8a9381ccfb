"""Step summaries: splits of crowded bins, fences, Kolmogorov-Smirnov bounds, merged co-moments, numbers of scans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airspark.operators import drift, eda
from airspark.operators.comoments import batch_moments, comoments
from airspark.operators.quantiles import long_values, quantiles, split_quantiles
from airspark.operators.steps import counted_bins, holds_any, quantile_values, steps

BY = ["station_id", "feature"]


def frame(spark, values, station=1):
    return spark.createDataFrame([(station, None if v is None else float(v)) for v in values], "station_id int, x double").repartition(5)


@pytest.mark.parametrize(
    "values",
    [
        1013 + np.random.default_rng(1).random(3000) * 1e-4,  # one bin holds all
        np.concatenate([np.full(2000, 5.0), 5.0 + np.random.default_rng(2).random(500) * 1e-9]),
        1.0 + np.power(2.0, -np.arange(1, 50).repeat(30)),  # ever closer values
    ],
)
def test_crowded_bins_are_split_until_they_are_small(spark, values):
    counts = {"n": F.lit(True)}
    long = long_values(frame(spark, values), ["x"], ["station_id"])
    near = holds_any([0.1, 0.5, 0.9])
    seen = []

    def mark(parts):
        seen.append(parts.agg(F.max("n"), F.count("*")).first())
        return parts.withColumn("near", near)

    exact = steps(long, counted_bins(long, BY, counts), BY, counts, mark, heavy=100)
    got = quantile_values(exact, BY, {"a": (0.1, "n"), "b": (0.5, "n"), "c": (0.9, "n")}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.9])), rel=1e-15)
    assert len(seen) >= 2 and got.total_n == len(values)
    rows = exact.orderBy("low").collect()
    assert sum(r.n for r in rows) == len(values)
    assert all(a.high < b.low for a, b in zip(rows, rows[1:]))


def test_split_quantiles_equal_the_others(spark):
    df = frame(spark, [*np.random.default_rng(3).gamma(2, 9, 400), None]).unionByName(frame(spark, [7.0] * 30, station=2))
    wanted = {"q25": 0.25, "q90": 0.9}
    assert sorted(split_quantiles(df, ["x"], wanted).collect()) == sorted(quantiles(df, ["x"], wanted).collect())


def test_fences_cut_bins_exactly(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(100, 5, 900), rng.normal(100, 30, 200), [113.0, 87.0]]).round(3)
    df = frame(spark, [*values, None, None])
    q25, q75 = np.quantile(values, [0.25, 0.75])
    low, high = q25 - 1.5 * (q75 - q25), q75 + 1.5 * (q75 - q25)
    got = eda.iqr_outliers(df, ["x"]).first()
    out = ((values < low) | (values > high)).sum()
    assert got.outliers == out > 10 and got.outlier_pct == pytest.approx(100 * out / (len(values) + 2))
    assert eda.iqr_upper(df, ["x"]).first().extreme_events == (values > high).sum()
    box = eda.box_summary(df, ["x"]).first()
    inside = values[(values >= low) & (values <= high)]
    assert (box.whisker_low, box.whisker_high) == (inside.min(), inside.max())


def test_values_on_a_fence_stay_inside(spark):
    values = [1, 2, 3, 4, 5, 8, -2, 8, -2, 100]
    q25, q75 = np.quantile(values, [0.25, 0.75])
    got = eda.iqr_outliers(frame(spark, values), ["x"]).first()
    want = sum(v < q25 - 1.5 * (q75 - q25) or v > q75 + 1.5 * (q75 - q25) for v in values)
    assert got.outliers == want


def test_outside_share_where_a_quantile_falls_between_bins(spark):
    # The 5 % quantile lies between 1 and 1000; current values lie in the empty space on both sides of it.
    base = [1.0] * 2 + [1000.0] * 20 + [1001.0]
    now = [40.0, 50.0, 60.0, 899.0, 999.0, 1000.5, 2000.0]
    got = drift.drift_metrics(frame(spark, base), frame(spark, now), ["x"]).first()
    p05, p95 = np.quantile(base, [0.05, 0.95])
    assert 1 < p05 < 1000
    assert (got.base_p05, got.base_p95) == (pytest.approx(p05), pytest.approx(p95))
    assert got.outside_share == pytest.approx(np.mean([v < p05 or v > p95 for v in now]))
    assert got.base_std == pytest.approx(np.std(base, ddof=1)) and got.current_mean == pytest.approx(np.mean(now))


@pytest.mark.parametrize("shift", [0.0, 1e-5, 0.3])
def test_ks_of_nearly_constant_columns(spark, shift):
    rng = np.random.default_rng(8)
    a, b = 1013 + rng.random(700) * 1e-4, 1013 + rng.random(400) * 1e-4 + shift
    got = drift.drift_ks(frame(spark, a), frame(spark, b), ["x"]).first()
    points = np.concatenate([a, b])
    want = max(abs((a <= p).mean() - (b <= p).mean()) for p in points)
    assert got.ks == pytest.approx(want, abs=1e-12)


def test_ks_keeps_a_station_with_one_sample(spark):
    got = drift.drift_ks(frame(spark, [1, 2]), frame(spark, [3], station=2), ["x"]).collect()
    assert {(r.station_id, r.ks, r.n_base, r.n_current) for r in got} == {(1, None, 2, 0), (2, None, 0, 1)}


def test_batch_moments_merge_to_the_correlation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, 800)
    y = 0.5 * x + rng.normal(0, 1, 800)
    rows = [(None if i % 9 == 0 else float(a), None if i % 7 == 0 else float(b), 3.3) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([(i % 2, *r) for i, r in enumerate(rows)], "station_id int, x double, y double, z double").repartition(7)
    got = {(r.station_id, r.a, r.b): r.r for r in comoments(df, [("x", "y"), ("x", "x"), ("z", "y")]).collect()}
    for station in (0, 1):
        own = np.array([[np.nan if v is None else v for v in r[:2]] for r in rows[station::2]])
        own = own[~np.isnan(own).any(axis=1)]
        assert got[(station, "x", "y")] == pytest.approx(np.corrcoef(own.T)[0, 1], rel=1e-9)
        assert got[(station, "x", "x")] == pytest.approx(1.0) and got[(station, "z", "y")] is None


def test_pairs_without_common_rows_keep_a_null(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, None, 2.0), (None, 1.0, 2.0), (None, 2.0, 4.0)], "station_id int, x double, y double")
    got = {r.station_id: r.r for r in comoments(df, [("x", "y")]).where("station_id is not null").collect()}
    assert got == {1: None}
    assert batch_moments(np.array([[np.nan, 1.0]]), np.array([0]), np.array([1]))[0, 0] == 0
    assert comoments(df.limit(0), [("x", "y")]).collect() == []


class Scans:
    """Counts how often rows of a source are read."""

    def __init__(self, spark, df):
        self.total = spark.sparkContext.accumulator(0)
        total = self.total

        def seen(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield batch

        self.rows = df.count()
        self.df = df.mapInArrow(seen, df.schema)

    def passes(self) -> float:
        return self.total.value / self.rows


def observations(spark, n=400):
    rng = np.random.default_rng(6)
    from airspark.schema import POLLUTANTS

    rows = [(i % 3, i % 24, 1 + i % 2, *map(float, rng.gamma(2, 20, len(POLLUTANTS)))) for i in range(n)]
    return spark.createDataFrame(rows, "station_id int, hour int, month int, " + ", ".join(f"{p} double" for p in POLLUTANTS))


def test_ks_reads_its_rows_at_most_twice(spark):
    scans = Scans(spark, observations(spark))
    drift.ks(drift.flagged(scans.df, F.col("hour") < 12), ["pm2_5", "o3"]).collect()
    assert 0 < scans.passes() <= 2


def test_correlations_read_their_rows_once(spark):
    scans = Scans(spark, observations(spark))
    eda.correlation_matrix(scans.df, ["pm2_5", "pm10", "o3", "co"]).collect()
    assert scans.passes() == 1
