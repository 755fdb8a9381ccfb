"""Recursive forecasts for many origins at once, and their back-tests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from airspark.functions.timefn import HOUR_US, add_hours
from airspark.operators.series import last_rows, row_windowed
from airspark.plans.ensemble import as_ensemble, is_ensemble
from airspark.plans.evaluate import actual_ahead, live_scores, regression_metrics
from airspark.plans.models import Fitted, assemble, raw_weights
from airspark.plans.serving import KEEP, calendar_columns, day_sums, history_columns, serving_columns
from airspark.schema import POLLUTANTS, STATION, TS
from airspark.session import use_checkpoints

STEPS = 72
OZONE_DECAY = 0.995
FOLLOWERS = ["pm10", "no2", "so2", "co"]
CHECKPOINT_EVERY = 12
HOLD_OUT, HOLD_OUT_MIN = 24, 48


def origins(df: DataFrame, extra: list[str] = (), **how) -> DataFrame:
    """Every row as a forecast origin: its values and the last 72 values up to it."""
    keep = [c for c in (STATION, TS, *POLLUTANTS, "aqi_change_rate", *extra) if c in df.columns]

    def build(w):
        return {"hist": F.collect_list("pm2_5").over(w.rowsBetween(-(KEEP - 1), 0))}

    return row_windowed(df.select(*keep), build, before=KEEP - 1, **how)


def _moved(prediction: Column, state: dict[str, Column]) -> dict[str, Column]:
    """The values assumed one hour later: particles and gases follow PM2.5, ozone decays."""
    scale = F.when(state["pm2_5"] > 0, prediction / state["pm2_5"]).otherwise(F.lit(1.0))
    out = {"pm2_5": prediction, "o3": state["o3"] * F.lit(OZONE_DECAY)}
    out.update({p: state[p] * scale for p in FOLLOWERS})
    return {p: out[p] for p in POLLUTANTS}


def _appended(hist: Column, prediction: Column) -> Column:
    kept = F.when(F.size(hist) >= KEEP, F.slice(hist, -(KEEP - 1), KEEP - 1)).otherwise(hist)
    return F.concat(kept, F.array(prediction))


def linear_forecast(states: DataFrame, fitted: Fitted, steps: int = STEPS) -> DataFrame:
    """Add the array ``forecast``. A linear model needs no loop: each origin is one fold."""
    start, weights = raw_weights(fitted)
    extra = {"aqi_change_rate": F.col("aqi_change_rate")} if "aqi_change_rate" in states.columns else {}

    # The calendar's part of each prediction does not depend on the recursion.
    def calendar_part(at: Column) -> Column:
        features = calendar_columns(at)
        return sum((F.lit(w) * features[n] for n, w in weights.items() if n in features), F.lit(start))

    hours = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda k: add_hours(F.col(TS), k))

    def advance(acc: Column, known: Column) -> Column:
        values = {p: acc[p] for p in POLLUTANTS}
        hist, total, squares = acc["hist"], acc["total"], acc["squares"]
        features = history_columns(hist, {**values, **extra}, (total, squares))
        leaving = F.coalesce(F.try_element_at(hist, F.lit(-24)), F.lit(0.0))
        guess = sum((F.lit(w) * features[n] for n, w in weights.items() if n in features), known)

        # One-element arrays bind the prediction, so that it is computed once.
        def next_state(y: Column) -> Column:
            return F.struct(
                _appended(hist, y).alias("hist"),
                (total + y - leaving).alias("total"),
                (squares + y * y - leaving * leaving).alias("squares"),
                *[c.alias(p) for p, c in _moved(y, values).items()],
                F.concat(acc["out"], F.array(y)).alias("out"),
            )

        return F.get(F.transform(F.array(guess), next_state), F.lit(0))

    total, squares = day_sums(F.col("hist"))
    zero = F.struct(
        F.col("hist"),
        total.alias("total"),
        squares.alias("squares"),
        *[F.col(p) for p in POLLUTANTS],
        F.array().cast("array<double>").alias("out"),
    )
    # Origins come out of the shuffle that numbered them; their histories are not moved again.
    return states.withColumn("forecast", F.aggregate(F.transform(hours, calendar_part), zero, advance, lambda a: a["out"]))


def stepwise_forecast(states: DataFrame, fitted: Fitted, steps: int = STEPS) -> DataFrame:
    """The same for any model: one prediction of all origins per step.

    The plan is cut with a checkpoint every few steps, so its size is bounded. A step whose
    inputs are not all known gives NULL.
    """
    use_checkpoints(states.sparkSession)
    names = [*POLLUTANTS] + (["aqi_change_rate"] if "aqi_change_rate" in states.columns else [])
    values = {p: F.col(p) for p in names}
    at = add_hours(F.col(TS), F.col("_k"))
    features = serving_columns(F.col("hist"), values, at)
    scaled = [
        ((features[n] - F.lit(fitted.scaler.mean[n])) / F.lit(fitted.scaler.divisor(n))).alias(f"f_{n}")
        for n in fitted.names
    ]
    held = [c for c in states.columns if c not in (*POLLUTANTS, "hist")]
    inputs = [f"f_{n}" for n in fitted.names]
    whole = reduce(and_, [F.col(n).isNotNull() for n in inputs])
    y = F.when(whole, F.col("prediction"))
    after = [
        *held,
        (F.col("_k") + 1).alias("_k"),
        *[c.alias(p) for p, c in _moved(y, values).items()],
        _appended(F.col("hist"), y).alias("hist"),
        F.concat("forecast", F.array(y)).alias("forecast"),
    ]
    now = states.withColumns({"_k": F.lit(1), "forecast": F.array().cast("array<double>")})
    for step in range(1, steps + 1):
        guessed = fitted.model.transform(assemble(now.select("*", *scaled), inputs, "keep"))
        now = guessed.select(*after)
        if step % CHECKPOINT_EVERY == 0 and step < steps:
            now = now.checkpoint()
    return now.drop("_k")


def _calendar(hours: np.ndarray) -> dict[str, np.ndarray]:
    """``calendar_columns`` of instants counted in microseconds."""
    at = hours.astype("datetime64[us]")
    day, month = at.astype("datetime64[D]"), at.astype("datetime64[M]")
    hour = (at - day).astype(np.int64) // HOUR_US
    number = month.astype(np.int64) % 12 + 1
    angle = {"hour": 2.0 * np.pi * hour / 24.0, "month": 2.0 * np.pi * number / 12.0}
    return {
        **{f"{n}_sin": np.sin(a) for n, a in angle.items()},
        **{f"{n}_cos": np.cos(a) for n, a in angle.items()},
        "hour_raw": hour,
        "month": number,
        "day": (day - month.astype("datetime64[D]")).astype(np.int64) + 1,
        "is_weekend": (day.astype(np.int64) + 3) % 7 >= 5,  # day 0 was a Thursday
    }


class _Walk:
    """The states of many origins, moved ahead together; missing values are NaN."""

    def __init__(self, batch: pa.RecordBatch, steps: int):
        hist = batch.column(batch.schema.get_field_index("hist"))
        begin = hist.offsets.to_numpy()
        sizes = np.diff(begin)
        known = np.asarray(hist.values.cast(pa.float64()).fill_null(np.nan))
        # Newest values lie right before ``at``; there is room for the steps to come.
        self.line = np.full((len(sizes), KEEP + steps), np.nan)
        for k in range(1, KEEP + 1):
            has = sizes >= k
            self.line[has, KEEP - k] = known[begin[1:][has] - k]
        self.at, self.sizes = KEEP, sizes
        self.values = {c: self._column(batch, c) for c in (*POLLUTANTS, "aqi_change_rate") if c in batch.schema.names}
        self.rate = self.values.pop("aqi_change_rate", None)
        self.start = np.asarray(batch.column(batch.schema.get_field_index(TS)).cast(pa.int64()))

    @staticmethod
    def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return np.asarray(batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).fill_null(np.nan))

    def features(self, step: int) -> dict[str, np.ndarray]:
        now, n = self.values["pm2_5"], np.minimum(self.sizes, KEEP)
        long, day = n >= KEEP, n >= 24

        def back(k: int) -> np.ndarray:
            return self.line[:, self.at - k]

        out = dict(self.values)
        for k in (1, 2, 3, 24, 48, 72):
            out[f"pm2_5_lag{k}"] = np.where(long, back(k), now)
        out["diff_1h"] = np.where(day, now - back(1), 0.0)
        out["diff_24h"] = np.where(day, now - back(24), 0.0)
        out["diff_1h_acc"] = np.where(day, (now - back(1)) - (back(1) - back(2)), 0.0)
        out["recent_hour_avg"] = (out["pm2_5_lag24"] + out["pm2_5_lag48"] + out["pm2_5_lag72"]) / 3.0
        last = self.line[:, self.at - 24 : self.at]
        mean = last.sum(axis=1) / 24.0
        variance = np.maximum((last * last).sum(axis=1) / 24.0 - mean * mean, 0.0) * (24.0 / 23.0)
        out["pm2_5_rolling_mean_24h"] = np.where(day, mean, now)
        out["pm2_5_rolling_std_24h"] = np.where(day, np.sqrt(variance), 0.0)
        if self.rate is not None:
            out["aqi_change_rate"] = self.rate
        else:
            previous = back(1)
            up = (n >= 2) & (previous > 0)
            out["aqi_change_rate"] = np.where(up, (now - previous) / np.where(up, previous, 1.0), 0.0)
        return {**out, **_calendar(self.start + step * HOUR_US)}

    def move(self, guess: np.ndarray) -> None:
        now = self.values["pm2_5"]
        scale = np.where(now > 0, guess / np.where(now > 0, now, 1.0), 1.0)
        moved = {p: self.values[p] * scale for p in FOLLOWERS}
        self.values = {**moved, "pm2_5": guess, "o3": self.values["o3"] * OZONE_DECAY}
        self.line[:, self.at] = guess
        self.at, self.sizes = self.at + 1, self.sizes + 1


def tree_forecast(states: DataFrame, fitted: Fitted, steps: int = STEPS) -> DataFrame:
    """Add the array ``forecast`` by walking all steps of many origins at once in each task.

    The ensemble is sent to the tasks as arrays. Origins are not moved: one pass, whatever
    the number of steps. A step whose inputs are not all known gives NULL, as do all after it.
    """
    trees = as_ensemble(states.sparkSession, fitted.model)
    names = fitted.names
    mean = np.array([fitted.scaler.mean[n] for n in names], float)
    width = np.array([fitted.scaler.divisor(n) for n in names], float)
    schema = T.StructType([*states.schema.fields, T.StructField("forecast", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walk = _Walk(batch, steps)
            out = np.full((batch.num_rows, steps), np.nan)
            for step in range(1, steps + 1):
                features = walk.features(step)
                x = (np.stack([np.asarray(features[n], float) for n in names], axis=1) - mean) / width
                whole = ~np.isnan(x).any(axis=1)
                out[whole, step - 1] = trees.predict(x[whole])
                walk.move(out[:, step - 1])
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * steps, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "forecast"])

    return states.mapInArrow(run, schema)


def recursive_forecast(states: DataFrame, fitted: Fitted, steps: int = STEPS) -> DataFrame:
    if hasattr(fitted.model, "coefficients"):
        return linear_forecast(states, fitted, steps)
    return (tree_forecast if is_ensemble(fitted.model) else stepwise_forecast)(states, fitted, steps)


def or_last_value(forecasts: DataFrame, steps: int = STEPS) -> DataFrame:
    """Where a model gave no complete forecast, the last known value repeated; ``status`` tells.

    A station without any known value keeps its rows, with NULL values.
    """
    known = F.filter("hist", lambda v: v.isNotNull())
    last = F.when(F.size(known) > 0, F.element_at(known, -1))
    broken = F.col("forecast").isNull() | F.exists("forecast", lambda v: v.isNull() | F.isnan(v))
    status = F.when(~broken, "model").when(last.isNotNull(), "last value").otherwise("not enough data")
    return forecasts.withColumn("status", status).withColumn("forecast", F.when(~broken, F.col("forecast")).otherwise(F.array_repeat(last, steps)))


def forecast_rows(forecasts: DataFrame) -> DataFrame:
    """One row per origin and step."""
    kept = [c for c in ("status",) if c in forecasts.columns]
    return forecasts.select(STATION, *kept, F.col(TS).alias("origin"), F.posexplode("forecast").alias("_i", "pm2_5")).select(
        STATION,
        *kept,
        "origin",
        (F.col("_i") + 1).alias("step"),
        add_hours(F.col("origin"), F.col("_i") + 1).alias(TS),
        "pm2_5",
    )


def backtest_t72(
    rows: DataFrame, is_test: Column, fitted: Fitted, last: int | None = None, steps: int = STEPS, **how
) -> DataFrame:
    """Scores of the last step over all test origins, or the last ``last`` of each station.

    ``rows`` are complete unscaled feature rows; ``is_test`` picks the origins.
    """
    marked = actual_ahead(rows.withColumn("_test", is_test), steps)
    states = origins(marked, ["_test", "actual_t72"], **how).where("_test")
    if last is not None:
        states = last_rows(states, last)
    ahead = recursive_forecast(states, fitted, steps)
    pairs = ahead.select(
        F.lit(fitted.name).alias("model"), F.col("actual_t72").alias("actual"), F.element_at("forecast", -1).alias("predicted")
    )
    return regression_metrics(pairs, ["model"])


def live_metrics(df: DataFrame, fitted: Fitted, hold_out: int = HOLD_OUT, minimum: int = HOLD_OUT_MIN) -> DataFrame:
    """Per station: forecast the last rows from those before them and score the result.

    Every station has a row; ``status`` tells those with fewer than ``minimum`` rows, and
    those whose forecast lacks an input, which have no scores.
    """
    keep = [c for c in (STATION, TS, *POLLUTANTS, "aqi_change_rate") if c in df.columns]
    newest = last_rows(df.select(*keep), KEEP + hold_out, rank="_r")
    rest = [c for c in keep if c != STATION]
    values = F.collect_list(F.when(F.col("_r") > hold_out, F.struct(TS, "pm2_5")))
    stations = newest.groupBy(STATION).agg(
        F.array_sort(values)["pm2_5"].alias("hist"),
        F.max(F.when(F.col("_r") == hold_out + 1, F.struct(*rest))).alias("_c"),
        F.array_sort(F.collect_list(F.when(F.col("_r") <= hold_out, F.struct(TS, "pm2_5"))))["pm2_5"].alias("_actual"),
        F.count("*").alias("_rows"),
    )
    states = stations.where(F.col("_rows") >= minimum).select(STATION, F.col("_c.*"), "hist", "_actual")
    ahead = recursive_forecast(states, fitted, hold_out)
    pairs = ahead.select(STATION, F.inline(F.arrays_zip(F.col("_actual").alias("actual"), F.col("forecast").alias("predicted"))))
    enough = F.when(F.col("_rows") < minimum, "not enough data")
    told = stations.select(STATION, enough.alias("_short")).join(live_scores(pairs), STATION, "left")
    status = F.coalesce("_short", F.when(F.col("n") > 0, "scored"), F.lit("no forecast"))
    return told.withColumns({"status": status, "n": F.coalesce("n", F.lit(0))}).drop("_short")
