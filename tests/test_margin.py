"""Epsilon-insensitive regression: optimality conditions and the search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from airspark.plans import margin, models
from airspark.plans.dataset import Scaler
from airspark.session import scratch_path


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    x[:, 3] = x[:, 2]  # a repeated column
    y = x @ [2.0, -1.0, 0.5, 0.5] + 3 + rng.standard_t(2, size=400)
    return x, y, np.arange(400) % 3


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, fold = data
    table = [(Vectors.dense(a), float(b), int(f)) for a, b, f in zip(x, y, fold)]
    return spark.createDataFrame(
        table, ["features", "target", "fold"]
    ).repartition(4).cache()


def gradient(x, y, point, c, epsilon):
    left = y - x @ point[:-1] - point[-1]
    pull = np.sign(left) * np.maximum(np.abs(left) - epsilon, 0)
    return np.append(point[:-1] - 2 * c * x.T @ pull, -2 * c * pull.sum())


def value(x, y, point, c, epsilon):
    return 0.5 * point[:-1] @ point[:-1] + c * (np.maximum(np.abs(y - x @ point[:-1] - point[-1]) - epsilon, 0) ** 2).sum()


SETTINGS = [{"C": c, "epsilon": e} for c in (0.01, 1.0, 100.0) for e in (0.0, 0.5, 3.0)]


def test_all_problems_meet_the_optimality_conditions(rows, data):
    x, y, fold = data
    problems = margin.solve(margin.as_rows(rows), SETTINGS, [0, 1, None])
    assert len(problems) == 27 and all(p.done for p in problems) and max(p.passes for p in problems) < 40
    rng = np.random.default_rng(1)
    for p in problems:
        keep = fold != p.fold if p.fold is not None else np.ones(len(y), bool)
        g = gradient(x[keep], y[keep], p.point, p.c, p.epsilon)
        assert np.abs(g).max() <= 1e-6 * max(p.scale, 1e-9)
        best = value(x[keep], y[keep], p.point, p.c, p.epsilon)
        assert p.value == pytest.approx(best, rel=1e-9)
        for _ in range(5):
            assert value(x[keep], y[keep], p.point + 0.01 * rng.normal(size=5), p.c, p.epsilon) >= best


def test_no_margin_is_ridge_regression(rows, data):
    x, y, _ = data
    p = margin.solve(margin.as_rows(rows), [{"C": 2.0, "epsilon": 0.0}], [None])[0]
    full = np.column_stack((x, np.ones(len(y))))
    want = np.linalg.solve(full.T @ full + np.diag([0.25] * 4 + [0.0]), full.T @ y)
    np.testing.assert_allclose(p.point, want, rtol=1e-6)


def test_errors_and_choice(rows, data):
    x, y, fold = data
    model, means = margin.margin_search(rows, SETTINGS, 3)
    problems = margin.solve(margin.as_rows(rows), SETTINGS, [0, 1, 2])
    want = [np.sqrt(((y - x @ p.point[:-1] - p.point[-1])[fold == p.fold] ** 2).mean()) for p in problems]
    np.testing.assert_allclose(means, np.reshape(want, (9, 3)).mean(axis=1), rtol=1e-9)
    best = SETTINGS[int(np.argmin(means))]
    assert np.abs(gradient(x, y, np.append(model.coefficients, model.intercept), best["C"], best["epsilon"])).max() < 1e-4


def test_model_predicts_and_is_stored(spark, rows, data):
    model = margin.MarginModel([1.0, 2.0, 0.0, -1.0], 5.0)
    path = scratch_path(spark, "margin")
    model.write().save(path)
    again = margin.MarginModel.load(path)
    got = again.transform(rows).select("features", "prediction").collect()
    for r in got:
        assert r.prediction == pytest.approx(r.features.toArray() @ [1.0, 2.0, 0.0, -1.0] + 5.0)


def test_a_search_over_the_grid(spark, data):
    x, y, _ = data
    names = list("abcd")
    table = [(i % 2, i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    train = spark.createDataFrame(table, "station_id int, h int, a double, b double, c double, d double, target double")
    train = train.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h)"))
    fitted, report = models.tuned("robust_linear", train, names, Scaler({n: 0.0 for n in names}, {n: 1.0 for n in names}))
    assert len(report) == len({r["settings"] for r in report}) == 15 and all(r["settings"].startswith("C=") for r in report)
    start, weights = models.raw_weights(fitted)
    # Heavy noise: narrow margins come close to least squares.
    least, *_ = np.linalg.lstsq(np.column_stack((x, np.ones(len(y)))), y, rcond=None)
    assert start == pytest.approx(least[4], abs=0.1) and weights["a"] == pytest.approx(least[0], abs=0.1)
