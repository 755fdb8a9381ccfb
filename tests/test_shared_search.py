"""Settings that differ in the number of trees share one fit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from airspark.plans import models
from airspark.plans.dataset import Scaler

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in (1, 2):
        for h in range(90):
            a, b, c = rng.normal(size=3)
            rows.append((s, h, float(a), float(b), float(c), float(3 * a + (b > 0) * c + rng.normal(0, 0.1))))
    df = spark.createDataFrame(rows, "station_id int, h int, a double, b double, c double, target double")
    return df.select("station_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h)").alias("ts"), *NAMES, "target").cache()


def plain_scaler():
    return Scaler({n: 0.0 for n in NAMES}, {n: 1.0 for n in NAMES})


@pytest.mark.parametrize(
    "name, fixed, grid",
    [
        ("gbt", {}, {"maxIter": [6, 2, 4], "maxDepth": [2, 3], "subsamplingRate": [0.7, 1.0], "featureSubsetStrategy": ["0.6", "1.0"]}),
        ("forest", {"bootstrap": False, "featureSubsetStrategy": "all"}, {"numTrees": [1, 3], "maxDepth": [2, 4]}),
    ],
)
def test_report_equals_separate_fits(train, name, fixed, grid):
    estimator = (models.gbt if name == "gbt" else models.forest)(**fixed)
    fitted, report = models.random_search(name, estimator, grid, train, NAMES, plain_scaler(), n_iter=5, folds=3)
    size = "maxIter" if name == "gbt" else "numTrees"
    drawn = models.draw_families(grid, size, 5)
    assert [r["settings"] for r in report] == [", ".join(f"{k}={v}" for k, v in s.items()) for s in drawn]
    rows = models.packed(models.assemble(models.contiguous_folds(train, 3), NAMES))
    score = RegressionEvaluator(labelCol="target", metricName="rmse")
    want = []
    for s in drawn:
        params = {estimator.getParam(k): v for k, v in s.items()}
        errors = []
        for f in range(3):
            part = models.packed(rows.where(F.col("fold") != f).select("features", "target"))
            errors.append(score.evaluate(estimator.fit(part, params).transform(rows.where(F.col("fold") == f))))
        want.append(sum(errors) / 3)
    np.testing.assert_allclose([r["rmse"] for r in report], want, rtol=1e-9)
    best = drawn[int(np.argmin(want))]
    assert len(fitted.model.trees) == best[size] and fitted.model.getMaxDepth() == best["maxDepth"]


def test_families_have_all_sizes():
    drawn = models.draw_families(models.GBT_GRID, "maxIter", 25)
    assert len(drawn) == len({tuple(d.items()) for d in drawn}) == 25
    rest = [tuple((k, v) for k, v in d.items() if k != "maxIter") for d in drawn]
    assert all(rest.count(r) == 5 for r in rest)
    assert {d["maxIter"] for d in drawn} == set(models.GBT_GRID["maxIter"])
    assert models.draw_families(models.GBT_GRID, "maxIter", 25) == drawn and len(models.draw_families({"numTrees": [1, 2]}, "numTrees", 9)) == 2
