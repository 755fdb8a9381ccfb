"""Values that are a quantile themselves lie within it."""

from __future__ import annotations

from pyspark.sql import functions as F

from airspark.operators import drift

# 412 values whose 5 % quantile is 623 + 0.55 * 100 = 678.
BASE = [100.0] * 20 + [623.0, 723.0] + [9000.0] * 390


def test_a_value_at_the_quantile_is_not_outside(spark):
    rows = [(1, True, v) for v in BASE] + [(1, False, v) for v in (678.0, 677.0, 700.0, 800.0)]
    both = spark.createDataFrame(rows, "station_id int, base boolean, co double")
    found = drift.metrics(drift.flagged(both, F.col("base")), ["co"]).first()
    assert found["base_p05"] == 678.0
    assert found["outside_share"] == 0.25
