"""Per-station models may win and are stored."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from airspark.plans import models, training
from airspark.plans.training import StationModel
from airspark.schema import POLLUTANTS
from airspark.session import scratch_path


def test_a_per_station_model_wins_and_is_loaded(spark):
    # A plain daily cycle, which the per-station models follow and a constant does not.
    values = [50 + 20 * math.sin(2 * math.pi * h / 24) + 0.01 * (h * 7919 % 13) for h in range(420)]
    rows = [(1, datetime(2024, 1, 1) + timedelta(hours=h), *[v] * 6) for h, v in enumerate(values)]
    df = spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, " + ", ".join(f"{p} double" for p in POLLUTANTS))
    df = df.withColumns({"hour": F.hour("ts"), "day": F.dayofmonth("ts"), "month": F.month("ts")})
    root = scratch_path(spark, "registry")
    # So strong a penalty leaves the mean alone.
    dull = LinearRegression(featuresCol=models.VECTOR, labelCol="target", regParam=1e6, elasticNetParam=1.0)
    table, version = training.train_and_compare(df, root, {"robust_linear": dull}, last=20, all_eligible=True)
    scores = {r.model: r.rmse for r in table.collect()}
    best = min(scores, key=scores.get)
    row = models.registry(spark, root).first()
    assert best in ("seasonal_ar", "harmonic") and version == 1 and row.model == best
    loaded = models.load(spark, root, StationModel)
    assert loaded.names == [] and loaded.model.table.where("status = 'fitted'").count() == 1
