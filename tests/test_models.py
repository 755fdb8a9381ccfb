"""Recursive forecasts, series models and explanations against plain Python."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from airspark.operators import leastsquares, univariate
from airspark.plans import dataset, explain, forecast, models, training
from airspark.plans.serving import recent_state
from airspark.schema import FEATURES, POLLUTANTS
from airspark.session import scratch_path

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in (1, 2):
        for h in range(260):
            base = 40 + 15 * math.sin(2 * math.pi * h / 24) + 5 * s + rng.normal(0, 4)
            rows.append((s, START + timedelta(hours=h), *[float(round(max(1.0, base * f), 3)) for f in (1, 1.5, 0.8, 0.5, 0.2, 10)]))
    df = spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, " + ", ".join(f"{p} double" for p in POLLUTANTS))
    return df.withColumns({"hour": F.hour("ts"), "day": F.dayofmonth("ts"), "month": F.month("ts")}).cache()


@pytest.fixture(scope="module")
def fitted(obs):
    rows, names, scaler = dataset.training_set(obs)
    estimator = LinearRegression(featuresCol=models.VECTOR, labelCol="target", regParam=0.1)
    return models.fit("linear", estimator, rows, names, scaler)


def python_forecast(fitted, hist, row, ts, steps):
    """A plain loop over one origin."""
    start, weights = models.raw_weights(fitted)
    hist, row, out = list(hist), dict(row), []
    for k in range(1, steps + 1):
        at = ts + timedelta(hours=k)
        now, n = row["pm2_5"], len(hist)
        f = dict(row)
        for lag in (1, 2, 3, 24, 48, 72):
            f[f"pm2_5_lag{lag}"] = hist[-lag] if n >= 72 else now
        f["diff_1h"] = now - hist[-1] if n >= 24 else 0.0
        f["diff_24h"] = now - hist[-24] if n >= 24 else 0.0
        f["diff_1h_acc"] = (now - hist[-1]) - (hist[-1] - hist[-2]) if n >= 24 else 0.0
        f["recent_hour_avg"] = np.mean([f["pm2_5_lag24"], f["pm2_5_lag48"], f["pm2_5_lag72"]])
        f["pm2_5_rolling_mean_24h"] = np.mean(hist[-24:]) if n >= 24 else now
        f["pm2_5_rolling_std_24h"] = np.std(hist[-24:], ddof=1) if n >= 24 else 0.0
        for name, value, period in (("hour", at.hour, 24), ("month", at.month, 12)):
            f[f"{name}_sin"], f[f"{name}_cos"] = math.sin(2 * math.pi * value / period), math.cos(2 * math.pi * value / period)
        f.update(hour_raw=at.hour, month=at.month, day=at.day, is_weekend=int(at.weekday() >= 5))
        y = start + sum(w * f[name] for name, w in weights.items())
        ratio = y / now if now > 0 else 1.0
        row = {p: row[p] * ratio for p in POLLUTANTS} | {"pm2_5": y, "o3": row["o3"] * 0.995}
        hist = (hist + [y])[-72:]
        out.append(y)
    return out


@pytest.mark.parametrize("rows", [200, 60, 10])
def test_fold_and_steps_equal_a_loop(obs, fitted, rows):
    now = START + timedelta(hours=rows - 1)
    states = recent_state(obs, now)
    fold = {r.station_id: r for r in forecast.linear_forecast(states, fitted, 30).collect()}
    steps = {r.station_id: r for r in forecast.stepwise_forecast(states, fitted, 30).collect()}
    for r in states.collect():
        assert len(r.hist) == min(72, rows)
        want = python_forecast(fitted, r.hist, {p: r[p] for p in POLLUTANTS}, r.ts, 30)
        np.testing.assert_allclose(fold[r.station_id].forecast, want, rtol=1e-6)
        np.testing.assert_allclose(steps[r.station_id].forecast, want, rtol=1e-6)


def test_history_without_the_current_row(obs):
    with_it = recent_state(obs, START + timedelta(hours=99)).where("station_id = 1").first()
    without = recent_state(obs, START + timedelta(hours=99), history_includes_current=False).where("station_id = 1").first()
    assert with_it.hist[-1] == with_it.pm2_5 and without.hist[-1] == with_it.hist[-2] and len(without.hist) == 72


def test_origins_hold_the_last_72_values(obs):
    got = {(r.station_id, r.ts): r.hist for r in forecast.origins(obs, block_rows=75).collect()}
    values = [r.pm2_5 for r in obs.where("station_id = 1").orderBy("ts").collect()]
    for h in (0, 10, 71, 72, 74, 75, 76, 149, 150, 259):
        assert got[(1, START + timedelta(hours=h))] == values[max(0, h - 71): h + 1]


def test_training_set_is_scaled_and_complete(obs):
    rows, names, scaler = dataset.training_set(obs)
    assert names == FEATURES and rows.count() == 2 * (260 - 73)
    stats = rows.agg(F.avg("pm2_5").alias("m"), F.stddev_pop("pm2_5").alias("s"), F.max("month_sin").alias("k")).first()
    assert abs(stats.m) < 1e-9 and stats.s == pytest.approx(1.0) and stats.k == 0.0
    direct, _, _ = dataset.training_set(obs, "direct")
    assert direct.count() == 2 * (260 - 144)


def test_splits_and_folds(obs):
    marked = dataset.chrono_split(obs).groupBy("station_id").agg(F.count_if("is_train").alias("a"), F.count_if("is_tuning").alias("b"))
    assert {(r.a, r.b) for r in marked.collect()} == {(208, 166)}
    folds = dataset.contiguous_folds(obs).groupBy("station_id", "fold").count().collect()
    assert sorted((r.station_id, r.fold, r["count"]) for r in folds) == [(1, 0, 87), (1, 1, 87), (1, 2, 86), (2, 0, 87), (2, 1, 87), (2, 2, 86)]


def test_sample_is_repeatable(obs):
    a = dataset.sample_rows(obs, 50).collect()
    assert len(a) == 50 and set(a) == set(dataset.sample_rows(obs.repartition(7), 50).collect())


def test_grouped_least_squares_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in (1, 2, 3):
        x = rng.normal(size=(40, 2))
        y = 3 * g + x @ [1.0, -g] + rng.normal(0, 0.1, 40)
        want[g] = np.linalg.lstsq(np.c_[np.ones(40), x], y, rcond=None)
        rows += [(g, float(a), float(b), float(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    for r in leastsquares.grouped_least_squares(df, ["g"], F.col("y"), [F.lit(1.0), F.col("a"), F.col("b")]).collect():
        np.testing.assert_allclose(r.coef, want[r.g][0], rtol=1e-8)
        assert r.rss == pytest.approx(want[r.g][1][0], rel=1e-6)


def test_series_models_follow_a_daily_cycle(spark):
    rows = [(1, START + timedelta(hours=h), 50 + 20 * math.sin(2 * math.pi * h / 24) + 0.01 * ((h * 7919) % 13)) for h in range(400)]
    df = spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, pm2_5 double")
    truth = [50 + 20 * math.sin(2 * math.pi * h / 24) for h in range(400, 448)]
    fitted = univariate.fit_seasonal_ar(df)
    ahead = [r.predicted for r in univariate.seasonal_ar_forecast(df, fitted, 48).orderBy("step").collect()]
    np.testing.assert_allclose(ahead, truth, atol=1.5)
    future = spark.createDataFrame([(1, START + timedelta(hours=h)) for h in range(400, 448)], "station_id int, ts timestamp_ntz")
    cycles = univariate.harmonic_predict(future, univariate.fit_harmonic(df)).orderBy("ts").collect()
    np.testing.assert_allclose([r.predicted for r in cycles], truth, atol=1.5)


def test_shapley_adds_up_and_is_exact_for_a_linear_model(obs, fitted):
    rows, names, _ = dataset.training_set(obs)
    few = dataset.sample_rows(rows, 3, seed=1)
    got = explain.shapley(few, rows, fitted, ["station_id", "ts"], permutations=15)
    means = dataset.sample_rows(rows.select("station_id", "ts", *names), 15).agg(*[F.avg(n).alias(n) for n in names]).first()
    coef = dict(zip(fitted.names, fitted.model.coefficients))
    for r in got.collect():
        assert r.impact == pytest.approx(coef[r.feature] * (r.value - means[r.feature]), abs=1e-6)


def test_surrogate_finds_linear_weights(obs, fitted):
    rows, _, _ = dataset.training_set(obs)
    got = explain.lime(dataset.sample_rows(rows, 2), fitted, ["station_id", "ts"], samples=800).collect()
    coef = dict(zip(fitted.names, fitted.model.coefficients))
    top = max(coef, key=lambda n: abs(coef[n]))
    assert len(got) == 20
    for r in got:
        if r.feature == top:
            assert r.weight == pytest.approx(coef[top], rel=0.2)


def test_fallback_only_for_silent_stations(spark):
    a = spark.createDataFrame([(1, "pm10", 2.0, 0.5), (1, "o3", 1.0, 0.0), (2, "pm10", 2.0, 0.0), (2, "o3", 1.0, 1e-5)], "station_id int, feature string, value double, impact double")
    f = spark.createDataFrame([(2, "pm10", 7.0), (1, "pm10", 9.0)], "station_id int, feature string, impact double")
    got = {(r.station_id, r.feature): (r.impact, r.is_heuristic) for r in explain.with_fallback(a, f).collect()}
    assert got == {(1, "pm10"): (0.5, False), (1, "o3"): (0.0, False), (2, "pm10"): (7.0, True), (2, "o3"): (0.0, True)}
    top = explain.top_drivers(a, n=1).orderBy("station_id").collect()
    assert [(r.feature, r.direction) for r in top] == [("PM10", "Pushing Up"), ("O3", "Pushing Up")]


def test_training_registers_the_winner(spark, obs):
    root = scratch_path(spark, "registry")
    chosen = {"robust_linear": models.robust_linear(maxIter=20), "gbt": models.gbt(maxIter=2, maxDepth=2)}
    table, version = training.train_and_compare(obs, root, chosen, last=5)
    scores = {r.model: r for r in table.collect()}
    assert set(scores) == {"robust_linear", "gbt", "seasonal_ar", "harmonic"} and version == 1
    assert scores["gbt"].n == scores["robust_linear"].n == 10
    row = models.registry(spark, root).first()
    assert row.model == min(chosen, key=lambda m: scores[m].rmse)
