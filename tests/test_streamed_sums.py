"""Sums of products of many groups are added as they come by."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from airspark.operators.leastsquares import whole_gram, wide_gram


def test_sums_are_those_of_numpy_over_batches_and_null_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(None if g == 3 else int(g), float(y), float(x)) for g, y, x in zip(rng.integers(0, 7, 500), rng.normal(size=500), rng.normal(size=500))]
    df = spark.createDataFrame(rows, "g int, y double, x double").repartition(5)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        sums = wide_gram(df, ["g"], F.col("y"), F.array(F.lit(1.0), F.col("x")))
        # No task holds an entry of every group in a map.
        assert "Aggregate" not in sums._jdf.queryExecution().optimizedPlan().toString()
        got = {r["g"]: r for r in sums.collect()}
    finally:
        spark.conf.set(size, before)
    assert len(got) == 7
    for g, r in got.items():
        part = np.array([(1.0, x, y) for k, y, x in rows if k == g])
        assert r["n"] == len(part)
        np.testing.assert_allclose(whole_gram(np.asarray(r["all"])), part.T @ part, rtol=1e-12)
