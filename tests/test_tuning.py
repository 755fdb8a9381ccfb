"""Registered tree fits and the training job search their settings."""

from __future__ import annotations

import pytest

from airspark.catalog import modeling
from airspark.plans import models, training

SF = "/root/testdata/sf0.01"


class Searched(Exception):
    pass


@pytest.mark.parametrize("name, query", [("gbt", "fit_gbt"), ("forest", "fit_rf")])
def test_trees_are_tuned_over_the_grid(spark, monkeypatch, name, query):
    seen = {}

    def search(name, estimator, grid, train, names, scaler, n_iter=20, folds=3, parallelism=4):
        seen.update(name=name, grid=grid, draws=n_iter, folds=folds)
        return models.fit(name, estimator, train, names, scaler), []

    monkeypatch.setattr(models, "random_search", search)
    monkeypatch.setattr(models, "gbt", lambda: models.GBTRegressor(featuresCol="features", labelCol="target", maxIter=2, maxDepth=2))
    monkeypatch.setattr(models, "forest", lambda: models.RandomForestRegressor(featuresCol="features", labelCol="target", numTrees=2, maxDepth=2))
    assert [r["model"] for r in getattr(modeling, query)(spark, SF).collect()] == [name]
    assert seen == {"name": name, "grid": {"gbt": models.GBT_GRID, "forest": models.RF_GRID}[name], "draws": 25, "folds": 3}


def test_the_training_job_is_tuned(monkeypatch):
    seen = []
    monkeypatch.setattr(training, "chrono_split", lambda x: x)
    monkeypatch.setattr(training, "labelled", lambda x: x)
    monkeypatch.setattr(training, "written", lambda x, _: x)

    class Rows:
        where = lambda self, _: self

    monkeypatch.setattr(training, "scaled_set", lambda x: (x, [], None))

    def tuned(name, *_):
        seen.append(name)
        if len(seen) == 3:
            raise Searched
        return None, []

    monkeypatch.setattr(models, "tuned", tuned)
    with pytest.raises(Searched):
        training.train_and_compare(Rows())
    assert seen == ["gbt", "forest", "robust_linear"]
