"""Per-station time-series models fitted with grouped least squares."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from airspark.functions.numbers import ratio
from airspark.functions.timefn import HOUR_US, micros
from airspark.operators.leastsquares import whole_gram, wide_gram
from airspark.operators.series import last_rows, row_windowed
from airspark.schema import STATION, TS
from airspark.session import written

# Fixed value: published 5 % critical value of the test with a constant.
CRITICAL = -2.86
SEASON = 24
#: Lagged steps of the augmented test, at most.
MOST_LAGS = 24
# Orders tried.
ORDERS = [(p, q, big_p, big_q) for p in (0, 1, 2) for q in (0, 1, 2) for big_p in (0, 1) for big_q in (0, 1)]
#: Lags of the long autoregression whose residuals stand for the shocks.
LONG_LAGS = [1, 2, 3, 4, 5, 6, 23, 24, 25, 26]
#: Rows that a value needs behind it: the longest lag, after both differences.
REACH = LONG_LAGS[-1] + SEASON + 1
MIN_ROWS = 48
ENOUGH, SHORT = "fitted", "not enough data"


def stationarity(df: DataFrame, value: str = "pm2_5", **how) -> DataFrame:
    """Dickey-Fuller regression per station: slope, its t-value, differences needed."""
    one = row_windowed(df.select(STATION, TS, value), lambda w: {"_lag": F.lag(value).over(w)}, before=1, **how)
    step = F.col(value) - F.col("_lag")
    s = one.groupBy(STATION).agg(
        F.regr_count(step, F.col("_lag")).alias("n"),
        F.regr_slope(step, F.col("_lag")).alias("slope"),
        F.regr_sxx(step, F.col("_lag")).alias("_sxx"),
        F.regr_syy(step, F.col("_lag")).alias("_syy"),
        F.regr_sxy(step, F.col("_lag")).alias("_sxy"),
    )
    c = F.col
    spread = ratio(F.greatest(c("_syy") - c("slope") * c("_sxy"), F.lit(0.0)), F.greatest(c("n") - 2, F.lit(0)).cast("double"))
    t = ratio(c("slope"), F.sqrt(ratio(spread, c("_sxx"))))
    return s.select(STATION, "n", "slope", t.alias("t_value")).withColumns(
        {
            "stationary": F.coalesce(F.col("t_value") < CRITICAL, F.lit(False)),
            "differences": F.when(F.col("t_value") < CRITICAL, F.lit(0)).otherwise(F.lit(1)),
        }
    )


def augmented_stationarity(df: DataFrame, value: str = "pm2_5", most_lags: int = MOST_LAGS, lags: int | None = None, **how) -> DataFrame:
    """Augmented Dickey-Fuller regression per station; every station has a row.

    The step is regressed on the level before it and on earlier steps. All numbers of
    earlier steps up to ``most_lags`` are solved on the same rows from one table of sums,
    whose triangular factor holds the factors of all smaller ones; the one with the lowest
    AIC counts, or ``lags`` if given. Stations whose rows do not suffice, and constant
    ones, have NULL values and count as not stationary.
    """
    stations = df.select(STATION).distinct()
    reach = most_lags + 1
    wide = row_windowed(
        df.select(STATION, TS, value),
        lambda w: {f"_l{k}": F.lag(value, k).over(w) for k in range(1, reach + 1)},
        before=reach,
        **how,
    ).na.drop("any", subset=[value, *[f"_l{k}" for k in range(1, reach + 1)]])
    at = [F.col(value), *[F.col(f"_l{k}") for k in range(1, reach + 1)]]
    steps = [at[k] - at[k + 1] for k in range(reach)]
    sums = wide_gram(wide, [STATION], steps[0], F.array(F.lit(1.0), at[1], *steps[1:]))
    kept = [f for f in sums.schema if f.name == STATION]
    schema = T.StructType(kept + [T.StructField("n", T.LongType()), T.StructField("lags", T.IntegerType()), T.StructField("slope", T.DoubleType()), T.StructField("t_value", T.DoubleType())])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, flat in zip(batch["n"], batch["all"]):
                whole = whole_gram(np.asarray(flat))
                best = (np.inf, None, None, None)
                try:
                    factor = np.linalg.cholesky(whole[:-1, :-1])
                    z = np.linalg.solve(factor, whole[:-1, -1])
                    left = whole[-1, -1] - np.cumsum(z * z)
                except np.linalg.LinAlgError:
                    factor = None
                for k in range(most_lags + 1) if lags is None else [lags]:
                    size, free = k + 2, n - k - 2
                    if factor is None or free <= 0 or left[size - 1] <= 1e-12 * whole[-1, -1]:
                        continue
                    inverse = np.linalg.inv(factor[:size, :size]).T
                    slope = float(inverse[1] @ z[:size])
                    error = np.sqrt(left[size - 1] / free * (inverse[1] @ inverse[1]))
                    aic = n * np.log(left[size - 1] / n) + 2 * size
                    if aic < best[0]:
                        best = (aic, k, slope, slope / error)
                out.append(best[1:])
            named = batch[[STATION, "n"]].copy()
            for i, c in enumerate(("lags", "slope", "t_value")):
                named[c] = pd.array([o[i] for o in out], dtype="Int32" if c == "lags" else "Float64")
            yield named

    found = stations.join(sums.mapInPandas(choose, schema), STATION, "left")
    return found.withColumns(
        {
            "n": F.coalesce("n", F.lit(0)),
            "stationary": F.coalesce(F.col("t_value") < CRITICAL, F.lit(False)),
            "differences": F.when(F.col("t_value") < CRITICAL, F.lit(0)).otherwise(F.lit(1)),
        }
    )


def _lagged(df: DataFrame, columns: list[str], lags: list[int], **how) -> DataFrame:
    return row_windowed(df, lambda w: {f"{c}_{k}": F.lag(c, k).over(w) for c in columns for k in lags}, before=max(lags), **how)


def _differences(df: DataFrame, value: str, **how) -> DataFrame:
    """The series after the station's plain differences, ``_y0`` without and ``_y1`` with seasonal ones."""
    wide = _lagged(df, [value], [1, SEASON, SEASON + 1], **how)

    def plain(now: str, before: str) -> Column:
        return F.when(F.col("d") == 0, F.col(now)).otherwise(F.col(now) - F.col(before))

    now, then = plain(value, f"{value}_1"), plain(f"{value}_{SEASON}", f"{value}_{SEASON + 1}")
    return wide.select(STATION, TS, "d", now.alias("_y0"), (now - then).alias("_y1"))


def fit_seasonal_ar(df: DataFrame, value: str = "pm2_5", **how) -> DataFrame:
    """Seasonal autoregression with moving-average terms per station, by lowest AIC over 72 orders.

    Two stages: a long autoregression gives residuals, which stand for the unknown shocks;
    the series is then regressed on its own lags (1, 2, 24) and those of the residuals. The
    36 orders without and with seasonal differences are all solved from one table of sums
    each, over the same rows. Every station has a row; ``status`` tells those whose rows do
    not suffice, which have NULL coefficients.

    ``coef`` holds the constant, the three own lags and the three residual lags (0 where
    the order lacks them), ``long_coef`` the long autoregression.
    """
    needed = augmented_stationarity(df, value, **how).select(STATION, F.col("differences").alias("d"))
    series = written(_differences(df.select(STATION, TS, value).join(needed, STATION), value, **how), "differences")
    both = ["_y0", "_y1"]
    lagged = written(_lagged(series, both, LONG_LAGS, **how), "lags")

    def complete(y, x) -> Column:
        return y.isNotNull() & ~F.exists(x, lambda v: v.isNull())

    def stage_rows(rows: DataFrame, xs) -> DataFrame:
        """One row per kind of seasonal difference with y and regressors, complete ones alone."""
        kinds = F.array(*[F.struct(F.lit(k).alias("seasonal_d"), F.col(f"_y{k}").alias("y"), xs(k).alias("x")) for k in (0, 1)])
        out = rows.select(STATION, "d", F.inline(kinds))
        return out.where(complete(F.col("y"), F.col("x")))

    long_xs = lambda k: F.array(F.lit(1.0), *[F.col(f"_y{k}_{j}") for j in LONG_LAGS])
    keys = [STATION, "d", "seasonal_d"]
    sums = wide_gram(stage_rows(lagged, long_xs), keys, F.col("y"), F.col("x"))
    size = len(LONG_LAGS) + 1
    longs = written(_solved(sums, keys, size), "long-coefficients")
    pivot = longs.groupBy(STATION).agg(*[F.max(F.when(F.col("seasonal_d") == k, F.col("long_coef"))).alias(f"_c{k}") for k in (0, 1)])
    # A residual is NULL where a lag is missing.
    guess = lambda k: sum((F.get(f"_c{k}", F.lit(i + 1)) * F.col(f"_y{k}_{j}") for i, j in enumerate(LONG_LAGS)), F.get(f"_c{k}", F.lit(0)))
    shocks = lagged.join(pivot, STATION).select(STATION, TS, "d", *both, *[f"{y}_{j}" for y in both for j in (1, 2, SEASON)], *[(F.col(f"_y{k}") - guess(k)).alias(f"_e{k}") for k in (0, 1)])
    shocks = _lagged(shocks, ["_e0", "_e1"], [1, 2, SEASON], **how)
    own = lambda k: F.array(F.lit(1.0), *[F.col(f"_{c}{k}_{j}") for c in ("y", "e") for j in (1, 2, SEASON)])
    # Rows that are complete for both kinds, so that their criteria compare.
    shocks = shocks.where(complete(F.col("_y0"), own(0)) & complete(F.col("_y1"), own(1)))
    orders = wide_gram(stage_rows(shocks, own), keys, F.col("y"), F.col("x"))
    fitted = _best_orders(orders, keys)
    best = fitted.groupBy(STATION).agg(F.min(F.struct("aic", *[c for c in fitted.columns if c not in (STATION, "aic")])).alias("_b")).select(STATION, "_b.*")
    best = best.join(longs.select(STATION, "seasonal_d", "long_coef"), [STATION, "seasonal_d"])
    out = needed.select(STATION).join(best, STATION, "left")
    return out.withColumn("status", F.when(F.col("coef").isNotNull(), ENOUGH).otherwise(SHORT))


def _solved(sums: DataFrame, keys: list[str], size: int) -> DataFrame:
    schema = T.StructType([f for f in sums.schema if f.name in keys] + [T.StructField("long_coef", T.ArrayType(T.DoubleType()))])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            grams = [whole_gram(np.asarray(a)) for a in batch["all"]]
            out["long_coef"] = [np.linalg.pinv(g[:size, :size], rcond=1e-12, hermitian=True) @ g[:size, -1] for g in grams]
            yield out

    return sums.mapInPandas(fit, schema)


def _best_orders(sums: DataFrame, keys: list[str]) -> DataFrame:
    """For each table of sums the order with the lowest AIC."""
    ints = ["p", "q", "seasonal_p", "seasonal_q"]
    schema = T.StructType(
        [f for f in sums.schema if f.name in keys]
        + [T.StructField(c, T.IntegerType()) for c in ints]
        + [T.StructField("n", T.LongType()), T.StructField("coef", T.ArrayType(T.DoubleType()))]
        + [T.StructField(c, T.DoubleType()) for c in ("rss", "aic")]
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n, flat in zip(batch["n"], batch["all"]):
                g, best = whole_gram(np.asarray(flat)), None
                for p, q, big_p, big_q in ORDERS:
                    use = [0, *range(1, 1 + p), *([3] if big_p else []), *range(4, 4 + q), *([6] if big_q else [])]
                    if n <= len(use):
                        continue
                    b = np.linalg.pinv(g[np.ix_(use, use)], rcond=1e-12, hermitian=True) @ g[use, -1]
                    rss = max(float(g[-1, -1] - b @ g[use, -1]), 0.0)
                    aic = float(n * np.log(max(rss / n, 1e-300)) + 2 * len(use))
                    if best is None or aic < best[-1]:
                        coef = np.zeros(7)
                        coef[use] = b
                        best = (p, q, big_p, big_q, n, coef.tolist(), rss, aic)
                rows.append(best or (None,) * 8)
            out = batch[keys].copy()
            for i, c in enumerate([*ints, "n", "coef", "rss", "aic"]):
                out[c] = [r[i] for r in rows]
            yield out.dropna(subset=["aic"])

    return sums.mapInPandas(fit, schema)


def seasonal_ar_forecast(df: DataFrame, fitted: DataFrame, steps: int, value: str = "pm2_5") -> DataFrame:
    """``station_id, step, predicted`` from the last values of each station; NULL where nothing was fitted.

    Only the newest rows of a station are gathered, as many as the longest lag of the
    shocks of the last day needs; many stations move ahead together in a task.
    """
    reach = REACH + SEASON + 2
    newest = last_rows(df.select(STATION, TS, value).where(F.col(value).isNotNull()), reach)
    hist = F.array_sort(F.collect_list(F.struct(TS, value)))[value]
    start = fitted.select(STATION, "d", "seasonal_d", "coef", "long_coef").join(newest.groupBy(STATION).agg(hist.alias("hist")), STATION, "left")
    schema = T.StructType([start.schema[STATION], T.StructField("ahead", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ahead = []
            for d, seasonal, coef, long_coef, line in zip(*[batch[c] for c in ("d", "seasonal_d", "coef", "long_coef", "hist")]):
                if coef is None or line is None or len(line) < reach:
                    ahead.append([None] * steps)
                    continue
                line, d, seasonal = np.asarray(line, float), int(d), int(seasonal)
                base = line[1:] - line[:-1] if d else line
                y = base[SEASON:] - base[:-SEASON] if seasonal else base
                far = LONG_LAGS[-1]
                known = np.stack([np.ones(len(y) - far), *[y[far - j : len(y) - j] for j in LONG_LAGS]], axis=1) @ np.asarray(long_coef)
                shocks = np.concatenate((y[far:] - known, np.zeros(steps)))[-(SEASON + steps) :]
                y, base, out = list(y), list(base), list(line)
                for h in range(steps):
                    e = [shocks[SEASON + h - j] for j in (1, 2, SEASON)]
                    y.append(float(np.dot(coef, [1.0, y[-1], y[-2], y[-SEASON], *e])))
                    base.append(y[-1] + (base[-SEASON] if seasonal else 0.0))
                    out.append(base[-1] + (out[-1] if d else 0.0))
                ahead.append(out[-steps:])
            yield pd.DataFrame({STATION: batch[STATION], "ahead": ahead})

    return start.mapInPandas(run, schema).select(STATION, F.posexplode("ahead").alias("_i", "predicted")).select(
        STATION, (F.col("_i") + 1).alias("step"), "predicted"
    )


def _harmonics(hours: Column, daily: int, weekly: int) -> list[Column]:
    out = []
    for period, order in ((24.0, daily), (168.0, weekly)):
        for k in range(1, order + 1):
            angle = hours * F.lit(2 * math.pi * k / period)
            out += [F.sin(angle), F.cos(angle)]
    return out


#: Kinks the trend may have, evenly over the first part of a series.
CHANGEPOINTS, CHANGE_SHARE = 25, 0.8
#: Width of the kinks' prior: the smaller, the straighter the trend.
CHANGE_SCALE = 0.05


def _design(ts: Column, origin: Column, span: Column, daily: int, weekly: int, changepoints: int) -> list[Column]:
    """Constant, slope, one hinge per changepoint, daily and weekly cycles."""
    hours = (micros(ts) - micros(origin)) / F.lit(float(HOUR_US))
    t = hours / span
    hinges = [F.greatest(t - F.lit(CHANGE_SHARE * (j + 1) / (changepoints + 1)), F.lit(0.0)) for j in range(changepoints)]
    return [F.lit(1.0), t, *hinges, *_harmonics(hours, daily, weekly)]


def shrunk_coefficients(whole: np.ndarray, n: int, hinges: slice, scale: float) -> np.ndarray:
    """Least squares with an absolute penalty on the hinges, from a table of sums alone.

    The free columns are eliminated exactly; coordinate descent runs on the hinges that
    are left. The penalty is the noise variance over ``scale`` times the size of y.
    """
    g, b, yy = whole[:-1, :-1], whole[:-1, -1], whole[-1, -1]
    kinks = np.arange(len(b))[hinges]
    free = np.setdiff1d(np.arange(len(b)), kinks)
    solve = np.linalg.pinv(g[np.ix_(free, free)], rcond=1e-12, hermitian=True)
    h = g[np.ix_(kinks, kinks)] - g[np.ix_(kinks, free)] @ solve @ g[np.ix_(free, kinks)]
    r = b[kinks] - g[np.ix_(kinks, free)] @ solve @ b[free]
    full = np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ b
    noise = max(float(yy - full @ b), 0.0) / n
    penalty = noise / (scale * np.sqrt(yy / n)) if yy > 0 else 0.0
    delta = np.zeros(len(kinks))
    for _ in range(20_000):
        before = delta.copy()
        for j in range(len(kinks)):
            if h[j, j] > 1e-12:
                rest = r[j] - h[j] @ delta + h[j, j] * delta[j]
                delta[j] = np.sign(rest) * max(abs(rest) - penalty, 0.0) / h[j, j]
        if len(kinks) == 0 or np.abs(delta - before).max() <= 1e-10 * (1 + np.abs(delta).max()):
            break
    coef = np.zeros(len(b))
    coef[kinks] = delta
    coef[free] = solve @ (b[free] - g[np.ix_(free, kinks)] @ delta)
    return coef


def fit_harmonic(
    df: DataFrame, daily: int = 4, weekly: int = 3, value: str = "pm2_5", changepoints: int = CHANGEPOINTS, scale: float = CHANGE_SCALE
) -> DataFrame:
    """Trend with changepoints, daily and weekly cycles on the log scale, so that they multiply.

    The slope may change at ``changepoints`` instants; an absolute penalty leaves most of
    the changes at zero. ``offset`` lifts a station whose values reach 0 or less so that
    its smallest is 1. Every station has a row; ``status`` tells those with fewer than two
    days of values, which have NULL coefficients.
    """
    present = df.select(STATION, TS, value).where(F.col(value).isNotNull())
    spans = present.groupBy(STATION).agg(
        F.count("*").alias("_rows"), F.min(TS).alias("origin"), F.max(TS).alias("_end"), F.min(value).alias("_least")
    )
    hours = (micros(F.col("_end")) - micros(F.col("origin"))) / F.lit(float(HOUR_US))
    offset = F.when(F.col("_least") > 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.col("_least"))
    spans = spans.where(F.col("_rows") >= MIN_ROWS).select(STATION, "origin", F.greatest(hours, F.lit(1.0)).alias("span"), offset.alias("offset"))
    keys = [STATION, "origin", "span", "offset"]
    xs = _design(F.col(TS), F.col("origin"), F.col("span"), daily, weekly, changepoints)
    # Rows of a station and quarter lie together, so that tasks hold sums of few stations.
    near = present.join(spans, STATION).repartition(STATION, F.date_trunc("quarter", TS)).sortWithinPartitions(STATION)
    sums = wide_gram(near, keys, F.log(F.col(value) + F.col("offset")), F.array(*xs))
    schema = T.StructType([f for f in sums.schema if f.name in (*keys, "n")] + [T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType())])
    hinges = slice(2, 2 + changepoints)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "n"]].copy()
            grams = [whole_gram(np.asarray(a)) for a in batch["all"]]
            coefs = [shrunk_coefficients(g, int(n), hinges, scale) for g, n in zip(grams, batch["n"])]
            out["coef"] = [c.tolist() for c in coefs]
            out["rss"] = [max(float(g[-1, -1] - 2 * c @ g[:-1, -1] + c @ g[:-1, :-1] @ c), 0.0) for g, c in zip(grams, coefs)]
            yield out

    out = df.select(STATION).distinct().join(sums.mapInPandas(fit, schema), STATION, "left")
    return out.withColumn("status", F.when(F.col("coef").isNotNull(), ENOUGH).otherwise(SHORT))


def harmonic_predict(df: DataFrame, fitted: DataFrame, daily: int = 4, weekly: int = 3, changepoints: int = CHANGEPOINTS) -> DataFrame:
    """Add ``predicted`` to rows of any time, past or future; NULL where nothing was fitted."""
    xs = _design(F.col(TS), F.col("origin"), F.col("span"), daily, weekly, changepoints)
    total = F.aggregate(F.zip_with("coef", F.array(*xs), lambda c, x: c * x), F.lit(0.0), lambda a, v: a + v)
    told = fitted.select(STATION, "origin", "span", "offset", "coef")
    return df.join(told, STATION, "left").withColumn("predicted", F.exp(total) - F.col("offset")).drop("origin", "span", "offset", "coef")
