"""Shapley values by regression on coalitions."""

from __future__ import annotations

from datetime import datetime, timedelta
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from airspark.plans import dataset, explain, models
from airspark.plans.dataset import Scaler
from airspark.plans.margin import MarginModel

NAMES = ["a", "b", "c", "d"]
PLAIN = Scaler({n: 0.0 for n in NAMES}, {n: 1.0 for n in NAMES})


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    start = datetime(2024, 1, 1)
    table = [(i % 2, start + timedelta(hours=i), *map(float, rng.normal(size=4))) for i in range(60)]
    df = spark.createDataFrame(table, "station_id int, ts timestamp_ntz, a double, b double, c double, d double")
    return df.withColumn("target", F.col("a") * F.col("b") + 2 * F.col("c") - F.abs("d")).cache()


def reference(predict, x, background):
    """All subsets, averaged over the background."""
    n, out = len(x), np.zeros(len(x))

    def value(known):
        mixed = background.copy()
        mixed[:, list(known)] = x[list(known)]
        return predict(mixed).mean()

    for i in range(n):
        for k in range(n):
            for s in combinations([j for j in range(n) if j != i], k):
                out[i] += factorial(k) * factorial(n - k - 1) / factorial(n) * (value((*s, i)) - value(s))
    return out


def test_linear_models_get_their_exact_values(rows):
    weights = [1.5, -2.0, 0.0, 4.0]
    fitted = models.Fitted("linear", MarginModel(weights, 3.0), NAMES, PLAIN)
    few = dataset.sample_rows(rows, 4, seed=1)
    means = dataset.sample_rows(rows.select("station_id", "ts", *NAMES), 6).agg(*[F.avg(n).alias(n) for n in NAMES]).first()
    got = explain.kernel_shapley(few, rows, fitted, ["station_id", "ts"], coalitions=32, starts=6).collect()
    assert len(got) == 16
    for r in got:
        assert r.impact == pytest.approx(weights[NAMES.index(r.feature)] * (r.value - means[r.feature]), abs=1e-9)


def test_trees_come_close_to_all_subsets_and_add_up(spark, rows):
    fitted = models.fit("gbt", models.gbt(maxIter=3, maxDepth=3), rows, NAMES, PLAIN)
    few = dataset.sample_rows(rows, 3, seed=5)
    background = np.array([[r[n] for n in NAMES] for r in dataset.sample_rows(rows.select("station_id", "ts", *NAMES), 5).collect()])
    from airspark.plans.ensemble import compiled

    predict = compiled(spark, fitted.model).predict
    got = {}
    for r in explain.kernel_shapley(few, rows, fitted, ["station_id", "ts"], coalitions=800, starts=5).collect():
        got.setdefault((r.station_id, r.ts), {})[r.feature] = r.impact
    assert len(got) == 3
    for r in few.collect():
        x = np.array([r[n] for n in NAMES])
        own = np.array([got[(r.station_id, r.ts)][n] for n in NAMES])
        assert own.sum() == pytest.approx(float(predict(x[None])[0] - predict(background).mean()), abs=1e-9)
        np.testing.assert_allclose(own, reference(predict, x, background), atol=0.12)
