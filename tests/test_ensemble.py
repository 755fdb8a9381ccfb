"""Compiled tree ensembles: predictions, forecasts and Shapley values."""

from __future__ import annotations

import math
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airspark.plans import dataset, ensemble, explain, forecast, models
from airspark.plans.dataset import Scaler
from airspark.plans.ensemble import Ensemble, compiled
from airspark.plans.serving import recent_state
from airspark.schema import POLLUTANTS

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in (1, 2, 3):
        for h in range(190 if s < 3 else 30):
            base = 40 + 15 * math.sin(2 * math.pi * h / 24) + 5 * s + rng.normal(0, 4)
            values = [float(round(max(0.0, base * f), 3)) for f in (1, 1.5, 0.8, 0.5, 0.2, 10)]
            if s == 2 and h == 189:
                values[1] = None  # the newest row lacks a pollutant
            rows.append((s, START + timedelta(hours=h), *values))
    df = spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, " + ", ".join(f"{p} double" for p in POLLUTANTS))
    return df.withColumns({"hour": F.hour("ts"), "day": F.dayofmonth("ts"), "month": F.month("ts")}).cache()


@pytest.fixture(scope="module")
def training(obs):
    rows, names, scaler = dataset.training_set(obs)
    return rows.cache(), names, scaler


@pytest.fixture(scope="module", params=["gbt", "forest"])
def fitted(training, request):
    rows, names, scaler = training
    estimator = models.gbt(maxIter=4, maxDepth=3) if request.param == "gbt" else models.forest(numTrees=4, maxDepth=4)
    return models.fit(request.param, estimator, rows, names, scaler)


def matrix(rows, names):
    return np.array([[float(r[n]) for n in names] for r in rows])


def test_arrays_predict_what_the_model_predicts(spark, fitted, training):
    rows, names, _ = training
    told = fitted.predict_scaled(rows).collect()
    trees = compiled(spark, fitted.model)
    np.testing.assert_allclose(trees.predict(matrix(told, names)), [r.prediction for r in told], rtol=1e-12)
    firsts = trees.predict_first(matrix(told, names), [1, 3, 4], fitted.name == "forest")
    np.testing.assert_allclose(firsts[:, 2], [r.prediction for r in told], rtol=1e-12)
    one = [t.predict for t in fitted.model.trees][0]
    assert len(trees.roots) == 4 and callable(one)


@pytest.mark.parametrize("hours", [189, 40, 5])
def test_walk_equals_step_by_step(obs, fitted, hours):
    states = recent_state(obs, START + timedelta(hours=hours))
    steps = {r.station_id: r.forecast for r in forecast.stepwise_forecast(states, fitted, 14).collect()}
    walked = forecast.tree_forecast(states, fitted, 14)
    got = {r.station_id: r.forecast for r in walked.collect()}
    assert set(got) == {1, 2, 3} == set(steps)
    for station, want in steps.items():
        if hours == 189 and station == 2:
            assert want == got[station] == [None] * 14
        else:
            np.testing.assert_allclose(got[station], want, rtol=1e-9)
    told = {r.station_id: r for r in forecast.or_last_value(walked, 14).collect()}
    if hours == 189:
        assert told[2].status == "last value" and told[2].forecast == [told[2].hist[-1]] * 14 and told[1].status == "model"
    assert walked.columns == [*states.columns, "forecast"]


def brute_shapley(trees: Ensemble, x: np.ndarray) -> np.ndarray:
    """All subsets of features, each by walking the trees."""
    n = len(x)

    def value(known):
        def below(at):
            left, right = trees.left[at], trees.right[at]
            if left == at:
                return trees.value[at]
            f = trees.feature[at]
            if f in known:
                return below(left if x[f] <= trees.threshold[at] else right)
            return (below(left) * trees.cover[left] + below(right) * trees.cover[right]) / trees.cover[at]

        return sum(w * below(r) for r, w in zip(trees.roots, trees.weight))

    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(rest, k):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                out[i] += weight * (value({*s, i}) - value(set(s)))
    return out


def random_tree(rng, depth, n):
    if depth == 0 or rng.random() < 0.15:
        return (float(rng.normal()), float(rng.integers(1, 50)))
    return (int(rng.integers(n)), float(rng.normal()), random_tree(rng, depth - 1, n), random_tree(rng, depth - 1, n))


@pytest.mark.parametrize("depth", [0, 1, 2, 5, 8])
def test_shapley_equals_all_subsets(monkeypatch, depth):
    rng = np.random.default_rng(depth)
    trees = Ensemble.nested([random_tree(rng, depth, 6) for _ in range(3)], [1.0, 0.1, -2.0])
    x = rng.normal(size=(5, 6))
    monkeypatch.setattr(ensemble, "CELLS", 64)
    got = trees.shapley(x)
    np.testing.assert_allclose(got, [brute_shapley(trees, r) for r in x], atol=1e-9)
    np.testing.assert_allclose(got.sum(axis=1), trees.predict(x) - trees.base, atol=1e-9)


def test_tree_shapley_adds_up_on_a_table(spark, fitted, training):
    rows, names, _ = training
    some = rows.orderBy("ts", "station_id").limit(40)
    told = {(r.station_id, r.ts): r.prediction for r in fitted.predict_scaled(some).collect()}
    base = compiled(spark, fitted.model).base
    got = explain.tree_shapley(some, fitted, ["station_id", "ts"])
    assert got.columns == ["station_id", "ts", "feature", "value", "impact"] and got.count() == 40 * len(names)
    for r in got.groupBy("station_id", "ts").agg(F.sum("impact").alias("total")).collect():
        assert r.total == pytest.approx(told[(r.station_id, r.ts)] - base, abs=1e-9)


def test_a_row_that_lacks_a_feature_has_no_impacts(spark):
    trees = Ensemble.nested([(0, 1.0, (1.0, 3.0), (2.0, 1.0))], [1.0])
    fixed = models.Fitted("fixed", trees, ["a", "b"], Scaler({"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0}))
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 1.0)], "station_id int, a double, b double")
    got = {(r.station_id, r.feature): r.impact for r in explain.tree_shapley(df, fixed, ["station_id"]).collect()}
    assert got == {(1, "a"): -0.25, (1, "b"): 0.0, (2, "a"): None, (2, "b"): None}
