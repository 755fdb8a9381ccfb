"""Index, labels and number functions at their edges."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from airspark.functions import aqi as index
from airspark.functions import labels
from airspark.functions.numbers import clean, coerce, mean_present
from airspark.functions.timefn import age_label, clock_label


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def results(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def expected_subindex(c, points):
    if c is None or math.isnan(c) or c < 0:
        return 0.0
    found = [k for k in range(len(points) - 1) if points[k] <= c <= points[k + 1]]
    if not found:
        return 500.0
    k = found[0]
    low, high = points[k], points[k + 1]
    return float(round((index.LEVELS[k + 1] - index.LEVELS[k]) / (high - low) * (c - low) + index.LEVELS[k]))


@pytest.mark.parametrize("name", list(index.SCALES))
def test_subindex_at_and_around_every_point(spark, name):
    points = index.SCALES[name].points
    values = [v for p in points for v in (p, p + 1e-9, p * 1.01)] + [-1.0, -1e-12, None, float("nan"), 1e9]
    got = results(column(spark, values), index.subindex("x", points))
    assert got == [expected_subindex(v, points) for v in values]


def test_halves_round_to_even(spark):
    # Index 50 is reached at 100, so that half indices are exact.
    got = results(column(spark, [1.0, 3.0, 5.0]), index.subindex("x", (0.0, 100.0), (0, 50)))
    assert got == [0.0, 2.0, 2.0]


def test_aqi_takes_the_worst_pollutant_and_skips_missing(spark):
    rows = [
        (0, None, None, None, None, None, None),
        (1, 12.0, None, None, None, None, None),
        (2, 12.0, 155.0, 10.0, 10.0, 10.0, 100.0),
        (3, float("nan"), 54.0, None, None, None, None),
        (4, 0.0, 0.0, 0.0, 0.0, 0.0, 9400.0),
    ]
    df = spark.createDataFrame(rows, "i int, pm2_5 double, pm10 double, o3 double, no2 double, so2 double, co double")
    assert results(df, index.aqi()) == [0, 50, 101 if expected_subindex(155.0, index.SCALES["pm10"].points) == 101 else 100, 50, 100]


def test_pm25_index_truncates_extends_and_caps(spark):
    values = [-5.0, 0.0, 12.0, 12.01, 35.4, 55.4, 150.4, 200.4, 250.4, 900.0, None]
    assert results(column(spark, values), index.pm25_to_aqi(F.col("x"))) == [0, 0, 50, 50, 100, 150, 200, 250, 300, 300, None]


def test_bands(spark):
    df = column(spark, [0, 50, 51, 100, 101, 150, 151, 200, 201, 300, 301, None], "int")
    words = results(df, index.category(F.col("x")))
    assert words[:3] == ["Good", "Good", "Moderate"]
    assert words[-2:] == ["Hazardous", None]
    assert results(df, index.card_status(F.col("x")))[-2] == "Unhealthy"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 700), min_size=2, max_size=30))
def test_index_never_falls_when_the_concentration_rises(spark, values):
    got = results(column(spark, sorted(values)), index.pollutant_index("pm2_5", "x"))
    assert got == sorted(got)


def test_coerce_and_clean(spark):
    df = column(spark, ["1.5", " 2 ", "x", "", "NaN", "Infinity", None], "string")
    assert results(df, coerce(F.col("x"))) == [1.5, 2.0, None, None, None, None, None]
    assert results(column(spark, [1.0, float("nan"), float("-inf")]), clean(F.col("x"))) == [1.0, None, None]


def test_mean_present_skips_missing(spark):
    df = spark.createDataFrame([(0, 1.0, None, 3.0), (1, None, None, None)], "i int, a double, b double, c double")
    assert results(df, mean_present(F.col("a"), F.col("b"), F.col("c"))) == [2.0, None]


def test_labels(spark):
    df = column(spark, [1.5, 0.5, 0.05, -0.5, -1.5, None])
    assert results(df, labels.trend(F.col("x"))) == [
        "worsening rapidly", "increasing slightly", "stable", "decreasing slightly", "improving rapidly", None]
    ages = column(spark, [-0.1, 0.001, 0.5, 1.0, 5.9, 24.0, 72.5])
    assert results(ages, age_label(F.col("x"))) == ["Forecast", "< 1 min", "30 min", "1 hour", "5 hours", "1 day", "3 days"]
    hours = column(spark, [0, 9, 12, 17], "int")
    assert results(hours, clock_label(F.col("x"))) == ["12 AM", "09 AM", "12 PM", "05 PM"]


def test_confidence_and_accuracy(spark):
    df = spark.createDataFrame(
        [(0, 0.9, 10.0, 5.0), (1, 0.9, 60.0, 50.0), (2, -1.0, 5.0, 5.0), (3, 0.8, 31.0, 26.0)], "i int, r2 double, rmse double, mae double"
    )
    got = results(df, F.round(labels.confidence(F.col("r2"), F.col("rmse"), F.col("mae")), 6))
    assert got == [90.0, 61.2, 0.0, 68.4]
    assert results(column(spark, [0.0, 35.0, 175.0, 700.0]), labels.display_accuracy(F.col("x"))) == [100.0, 95.0, 50.0, 0.0]
