"""Augmented stationarity test and the seasonal model with moving-average terms against numpy."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airspark.operators import leastsquares, univariate

START = datetime(2024, 1, 1)


def table(spark, series):
    rows = [(s, START + timedelta(hours=h), None if v is None else float(v)) for s, values in series.items() for h, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, pm2_5 double")


def simulated(n, ar, ma, seasonal_ma=0.0, seed=0):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 100), np.zeros(n + 100)
    for t in range(30, n + 100):
        y[t] = ar * y[t - 1] + e[t] + ma * e[t - 1] + seasonal_ma * e[t - 24]
    return y[100:]


def test_wide_sums_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x, y, g = rng.normal(size=(300, 4)), rng.normal(size=300), rng.integers(0, 3, 300)
    rows = [(int(k), None if k == 2 else "a", [float(v) for v in r], float(t)) for k, r, t in zip(g, x, y)]
    df = spark.createDataFrame(rows, "g int, s string, x array<double>, y double").repartition(5)
    got = leastsquares.wide_gram(df, ["g", "s"], F.col("y"), F.col("x")).collect()
    assert len(got) == 3
    for r in got:
        both = np.column_stack((x, y))[g == r["g"]]
        assert r["n"] == len(both)
        np.testing.assert_allclose(leastsquares.whole_gram(np.array(r["all"])), both.T @ both, rtol=1e-10)


def plain_test(values, most, lags=None):
    values = np.asarray(values, float)
    step = np.diff(values)
    y = step[most:]
    columns = [np.ones(len(y)), values[most:-1], *[step[most - k : len(step) - k] for k in range(1, most + 1)]]
    best = None
    for k in range(most + 1) if lags is None else [lags]:
        x = np.column_stack(columns[: k + 2])
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        rss = float(((y - x @ beta) ** 2).sum())
        error = math.sqrt(rss / (len(y) - k - 2) * np.linalg.inv(x.T @ x)[1, 1])
        aic = len(y) * math.log(rss / len(y)) + 2 * (k + 2)
        if best is None or aic < best[0]:
            best = (aic, k, beta[1], beta[1] / error, len(y))
    return best[1:]


@pytest.mark.parametrize("lags", [None, 0, 3])
def test_augmented_test_equals_regressions(spark, lags):
    walk = np.cumsum(np.random.default_rng(1).normal(size=300))
    series = {1: simulated(300, 0.5, 0.4), 2: walk, 3: [1.0] * 100, 4: [1.0, 2.0], 5: [None] * 40}
    got = {r.station_id: r for r in univariate.augmented_stationarity(table(spark, series), most_lags=6, lags=lags).collect()}
    for s in (1, 2):
        k, slope, t, n = plain_test(series[s], 6, lags)
        assert (got[s].lags, got[s].n) == (k, n)
        assert got[s].slope == pytest.approx(slope, rel=1e-7) and got[s].t_value == pytest.approx(t, rel=1e-7)
    assert got[1].stationary and got[1].differences == 0 and not got[2].stationary and got[2].differences == 1
    for s in (3, 4, 5):
        assert got[s].t_value is None and not got[s].stationary and got[s].differences == 1


def test_simulated_coefficients_are_recovered(spark):
    series = {1: 20 + simulated(4000, 0.6, 0.5, seed=3), 2: simulated(4000, 0.0, 0.0, 0.6, seed=4), 3: [5.0, 6.0, 7.0]}
    got = {r.station_id: r for r in univariate.fit_seasonal_ar(table(spark, series), block_rows=1000).collect()}
    assert set(got) == {1, 2, 3} and got[3].status == "not enough data" and got[3].coef is None
    one, two = got[1], got[2]
    # Responses to a shock after one and two steps: they do not depend on factors that cancel out.
    c = one.coef
    assert one.seasonal_d == 0 and one.q >= 1 and c[1] + c[4] == pytest.approx(1.1, abs=0.05)
    assert c[1] * (c[1] + c[4]) + c[2] + c[5] == pytest.approx(0.66, abs=0.05)
    assert two.seasonal_q == 1 and two.coef[6] == pytest.approx(0.6, abs=0.07)
    assert one.rss / one.n == pytest.approx(1.0, abs=0.1)


def test_orders_are_chosen_by_aic(spark):
    values = simulated(600, 0.7, 0.0, seed=5)
    r = univariate.fit_seasonal_ar(table(spark, {1: values})).first()
    lags, far = univariate.LONG_LAGS, univariate.LONG_LAGS[-1]
    found = []
    for big_d in (0, 1):
        full = values[24:] - values[:-24] if big_d else values
        full = full if r.d == 0 else np.diff(full)
        x = np.column_stack([np.ones(len(full) - far), *[full[far - j : len(full) - j] for j in lags]])
        e = np.concatenate((np.full(far, np.nan), full[far:] - x @ np.linalg.lstsq(x, full[far:], rcond=None)[0]))
        # The same instants for both kinds of difference.
        rows = np.arange(far + (24 if big_d else 48), len(full))
        for p, q, big_p, big_q in univariate.ORDERS:
            columns = [np.ones(len(rows))] + [full[rows - k] for k in range(1, p + 1)] + ([full[rows - 24]] if big_p else [])
            columns += [e[rows - k] for k in range(1, q + 1)] + ([e[rows - 24]] if big_q else [])
            x = np.column_stack(columns)
            b, *_ = np.linalg.lstsq(x, full[rows], rcond=None)
            rss = float(((full[rows] - x @ b) ** 2).sum())
            found.append((len(rows) * math.log(rss / len(rows)) + 2 * x.shape[1], big_d, p, q, big_p, big_q, rss))
    aic, big_d, p, q, big_p, big_q, rss = min(found)
    assert (r.seasonal_d, r.p, r.q, r.seasonal_p, r.seasonal_q) == (big_d, p, q, big_p, big_q)
    assert r.aic == pytest.approx(aic, rel=1e-6) and r.rss == pytest.approx(rss, rel=1e-6)


def test_forecast_uses_shocks_and_keeps_every_station(spark):
    values = list(simulated(2000, 0.0, 0.9, seed=6))
    df = table(spark, {1: values, 2: [1.0, 2.0]})
    fitted = univariate.fit_seasonal_ar(df)
    got = {(r.station_id, r.step): r.predicted for r in univariate.seasonal_ar_forecast(df, fitted, 3).collect()}
    assert set(got) == {(s, k) for s in (1, 2) for k in (1, 2, 3)} and got[(2, 1)] is None
    r = fitted.where("station_id = 1").first()
    assert r.q >= 1
    # One step ahead of a moving average is its coefficient times the last shock.
    e = np.zeros(len(values))
    for t in range(1, len(values)):
        e[t] = values[t] - 0.9 * e[t - 1]
    assert got[(1, 1)] == pytest.approx(0.9 * e[-1], abs=0.35)


def test_planted_kinks_are_found(spark):
    rng = np.random.default_rng(7)
    hours = np.arange(24 * 60)
    t = hours / hours[-1]
    # Two of the 25 possible kinks, far apart.
    kinks = [0.8 * 7 / 26, 0.8 * 20 / 26]
    trend = 3 + 1.0 * t - 3.0 * np.maximum(t - kinks[0], 0) + 4.0 * np.maximum(t - kinks[1], 0)
    log = trend + 0.2 * np.sin(2 * np.pi * hours / 24) + 0.1 * np.cos(2 * np.pi * hours / 168) + rng.normal(0, 0.02, len(hours))
    df = table(spark, {1: np.exp(log)})
    coef = np.array(univariate.fit_harmonic(df).first().coef)
    places = 0.8 * np.arange(1, 26) / 26
    got = [3 + 0 * t, coef[1] * t, *[c * np.maximum(t - p, 0) for c, p in zip(coef[2:27], places)]]
    slopes = np.diff(sum(got[1:])) / np.diff(t)
    want = np.diff(trend) / np.diff(t)
    assert np.abs(slopes - want).mean() < 0.15  # the penalty rounds the kinks a little
    near = [abs(places - k) < 0.065 for k in kinks]
    assert coef[2:27][near[0]].sum() == pytest.approx(-3.0, abs=0.4) and coef[2:27][near[1]].sum() == pytest.approx(4.0, abs=0.4)
    assert np.abs(coef[2:27][~(near[0] | near[1])]).sum() < 0.5


def test_penalised_fit_meets_its_conditions():
    rng = np.random.default_rng(8)
    x = np.column_stack((np.ones(200), rng.normal(size=(200, 6))))
    y = x @ [1, 2, 0, 0, 3, 0, 0] + rng.normal(size=200)
    whole = np.column_stack((x, y)).T @ np.column_stack((x, y))
    coef = univariate.shrunk_coefficients(whole, 200, slice(2, 6), 0.002)
    full = np.linalg.lstsq(x, y, rcond=None)[0]
    penalty = ((y - x @ full) ** 2).sum() / 200 / (0.002 * np.sqrt((y * y).sum() / 200))
    slope = x.T @ (y - x @ coef)
    np.testing.assert_allclose(slope[[0, 1, 6]], 0, atol=1e-6)
    for j in range(2, 6):
        assert (abs(slope[j] - np.sign(coef[j]) * penalty) < 1e-6) if coef[j] else (abs(slope[j]) <= penalty + 1e-6)
    assert 0 in coef[2:6]


def test_values_at_or_below_zero_and_short_stations_stay(spark):
    hours = np.arange(200)
    df = table(spark, {1: 5 * np.sin(2 * np.pi * hours / 24), 2: [1.0, 2.0], 3: [None] * 60})
    fitted = univariate.fit_harmonic(df)
    got = {r.station_id: r for r in fitted.collect()}
    assert got[1].n == 200 and got[1].offset == pytest.approx(6.0) and got[1].status == "fitted"
    assert {got[s].status for s in (2, 3)} == {"not enough data"}
    told = univariate.harmonic_predict(df, fitted)
    rows = {(r.station_id, r.ts): r for r in told.collect()}
    assert len(rows) == 262 and all(r.predicted is None for (s, _), r in rows.items() if s != 1)
    error = [abs(r.predicted - r.pm2_5) for (s, _), r in rows.items() if s == 1]
    assert np.mean(error) < 0.6
