"""Explanations of predictions: Shapley values, local surrogates, driver tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from airspark.operators.eda import correlations_with
from airspark.operators.leastsquares import whole_gram, wide_gram
from airspark.plans.dataset import sample_rows
from airspark.plans.ensemble import as_ensemble
from airspark.plans.models import VECTOR, Fitted
from airspark.schema import STATION, TS
from airspark.session import written

# Names shown for the features, in model order.
DISPLAY_NAMES = {
    "pm2_5": "PM2.5", "pm10": "PM10", "o3": "O3", "no2": "NO2", "so2": "SO2", "co": "CO",
    "pm2_5_lag1": "PM2.5 Lag 1h", "pm2_5_lag2": "PM2.5 Lag 2h", "pm2_5_lag3": "PM2.5 Lag 3h",
    "pm2_5_lag24": "PM2.5 Lag 24h", "pm2_5_lag48": "PM2.5 Lag 48h", "pm2_5_lag72": "PM2.5 Lag 72h",
    "diff_1h": "Diff 1h", "diff_24h": "Diff 24h", "diff_1h_acc": "Diff 1h Acc",
    "recent_hour_avg": "Recent Hour Avg",
    "pm2_5_rolling_mean_24h": "Rolling Mean 24h", "pm2_5_rolling_std_24h": "Rolling Std 24h",
    "hour_sin": "Hour Sin", "hour_cos": "Hour Cos", "hour_raw": "Hour Raw",
    "month_sin": "Month Sin", "month_cos": "Month Cos", "month": "Month",
    "day": "Day", "is_weekend": "Is Weekend", "aqi_change_rate": "AQI Change Rate",
}
UP, DOWN = "Pushing Up", "Pulling Down"
TINY, FALLBACK_SCALE = 0.001, 10.0
TOP = 10
#: Instances of one task; each of them becomes hundreds or thousands of rows there.
INSTANCES = 64


def _vector(names: list[str]) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names])


def linear_attribution(df: DataFrame, weights: dict[str, float], means: dict[str, float], key: list[str]) -> DataFrame:
    """Exact Shapley values of a linear model: weight times distance from the mean."""
    items = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.col(n).cast("double").alias("value"),
                (F.lit(w) * (F.col(n) - F.lit(means[n]))).alias("impact"),
            )
            for n, w in weights.items()
        ]
    )
    return df.select(*key, F.inline(items))


def _dealt(instances: DataFrame, key: list[str]) -> DataFrame:
    """Instances dealt to tasks by their number.

    Each of them becomes many rows, but they are so few bytes themselves that their shuffle
    would be merged into one task. Dealt by key, what is made of an instance is grouped where it is.
    """
    kept = written(instances, "instances")
    n = kept.count()
    parts = max(-(-n // INSTANCES), min(n, instances.sparkSession.sparkContext.defaultParallelism), 1)
    return kept.repartition(parts, *key)


def shapley(
    instances: DataFrame, background: DataFrame, fitted: Fitted, key: list[str], permutations: int = 20, seed: int = 42
) -> DataFrame:
    """Shapley values by sampled feature orders, for any model.

    ``instances`` and ``background`` hold scaled features. Each order starts at
    one background row and switches the features to the instance one by one; the
    change of the prediction at a switch belongs to that feature.
    """
    names = fitted.names
    # The background is a sample of ``permutations`` rows by construction.
    starts = sample_rows(background.select(STATION, TS, *names), permutations, seed).select(
        (F.row_number().over(Window.orderBy(STATION, TS)) - 1).alias("_m"), _vector(names).alias("_z")
    )
    runs = _dealt(instances.select(*key, *names), key).select(*key, _vector(names).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_m"))
    index = F.sequence(F.lit(0), F.lit(len(names) - 1))
    order = F.array_sort(F.transform(index, lambda i: F.struct(F.xxhash64(F.lit(seed), "_m", *key, i).alias("h"), i.alias("i"))))["i"]
    steps = (
        runs.join(F.broadcast(starts), "_m")
        .withColumn("_order", order)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    )
    switched = F.slice("_order", F.lit(1), F.col("_j"))
    mixed = F.transform(
        index, lambda i: F.when(F.array_contains(switched, i), F.get("_x", i)).otherwise(F.get("_z", i))
    )
    scored = fitted.model.transform(steps.withColumn(VECTOR, array_to_vector(mixed)))
    y = F.col("prediction")
    shares = F.array(
        F.struct(F.get("_order", F.col("_j") - 1).alias("i"), y.alias("d")),
        F.struct(F.get("_order", F.col("_j")).alias("i"), (-y).alias("d")),
    )
    # The first state has no switch before it and the last none after it: their index is NULL.
    return (
        scored.select(*key, F.col("_x"), F.inline(shares))
        .where(F.col("i").isNotNull())
        .groupBy(*key, "i")
        .agg((F.sum("d") / permutations).alias("impact"), F.first(F.get("_x", F.col("i"))).alias("value"))
        .select(*key, F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("feature"), "value", "impact")
    )


def kernel_shapley(
    instances: DataFrame,
    background: DataFrame,
    fitted: Fitted,
    key: list[str],
    coalitions: int = 256,
    starts: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Shapley values of any model by a weighted regression on sampled coalitions.

    A coalition takes some features from the instance and the rest from ``starts``
    background rows, whose predictions are averaged. Sizes are drawn by the Shapley kernel,
    so all coalitions weigh the same in the regression; each comes with its complement.
    The impacts are made to add up to the prediction minus the mean of the background. A
    linear model gets its exact values. ``coalitions`` should be several times the number
    of features. Predictions of a coalition and sums of products are grouped aggregates;
    an instance is a few hundred rows, whatever the size of the data.
    """
    names = fitted.names
    size = len(names)
    if size < 2:
        raise ValueError("a coalition needs two features at least")
    weights = np.array([1.0 / (k * (size - k)) for k in range(1, size)])
    below = F.array(*[F.lit(float(c)) for c in np.cumsum(weights / weights.sum())[:-1]])
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *key, "_pair"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    index = F.sequence(F.lit(0), F.lit(size - 1))
    order = F.array_sort(F.transform(index, lambda i: F.struct(F.xxhash64(F.lit(seed + 1), *key, "_pair", i).alias("h"), i.alias("i"))))["i"]
    drawn = (
        _dealt(instances.select(*key, *names), key).select(*key, _vector(names).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(coalitions // 2 - 1))).alias("_pair"))
        .withColumn("_size", F.size(F.filter(below, lambda c: c < uniform)) + 1)
        .withColumn("_in", F.slice(order, F.lit(1), F.col("_size")))
        .withColumn("_z", F.transform(index, lambda i: F.array_contains("_in", i).cast("double")))
    )
    # The empty and the full coalition give the base and the prediction.
    none, all_ = (F.array_repeat(F.lit(v), size) for v in (0.0, 1.0))
    other = F.transform("_z", lambda z: 1.0 - z)
    kinds = F.when(F.col("_pair") == 0, F.array(F.col("_z"), other, none, all_)).otherwise(F.array(F.col("_z"), other))
    asked = drawn.select(*key, "_x", "_pair", F.posexplode(kinds).alias("_kind", "_z"))
    # The background is a sample of ``starts`` rows by construction; they stand in the plan.
    rows = sample_rows(background.select(STATION, TS, *names), starts, seed).select(*[F.col(n).cast("double") for n in names]).collect()
    table = F.array(*[F.array(*[F.lit(v) for v in r]) for r in rows])
    mixed = asked.withColumn("_b", F.explode(table)).withColumn(
        VECTOR, array_to_vector(F.zip_with("_z", F.zip_with("_x", "_b", lambda x, b: F.struct(x.alias("x"), b.alias("b"))), lambda z, v: F.when(z > 0, v["x"]).otherwise(v["b"])))
    )
    values = fitted.model.transform(mixed).groupBy(*key, "_pair", "_kind").agg(F.first("_z").alias("_z"), F.first("_x").alias("_x"), F.avg("prediction").alias("_v"))
    ends = values.where(F.col("_kind") >= 2).groupBy(*key).agg(
        F.max(F.when(F.col("_kind") == 2, F.col("_v"))).alias("_base"), F.max(F.when(F.col("_kind") == 3, F.col("_v"))).alias("_full"), F.first("_x").alias("_x")
    )
    # The last feature's impact follows from the sum, so it is taken out of the regression.
    last = F.get("_z", F.lit(size - 1))
    free = F.transform(F.slice("_z", 1, size - 1), lambda z: z - last)
    told = values.where(F.col("_kind") < 2).select(*key, "_z", "_v").join(ends.select(*key, "_base", "_full"), key)
    sums = wide_gram(told, key, F.col("_v") - F.col("_base") - last * (F.col("_full") - F.col("_base")), free)
    schema = T.StructType([f for f in sums.schema if f.name in key] + [T.StructField("_free", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[key].copy()
            grams = [whole_gram(np.asarray(a)) for a in batch["all"]]
            out["_free"] = [(np.linalg.pinv(g[:-1, :-1], rcond=1e-12, hermitian=True) @ g[:-1, -1]).tolist() for g in grams]
            yield out

    found = sums.mapInPandas(solve, schema).join(ends, key)
    rest = F.col("_full") - F.col("_base") - F.aggregate("_free", F.lit(0.0), lambda a, v: a + v)
    items = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_x").alias("value"), F.concat("_free", F.array(rest)).alias("impact")
    )
    return found.select(*key, F.inline(items))


def tree_shapley(instances: DataFrame, fitted: Fitted, key: list[str]) -> DataFrame:
    """Exact Shapley values of a tree ensemble, by the training weights along its paths.

    ``instances`` holds scaled features. The impacts of a row add up to its prediction
    minus the ensemble's base value. Rows stay where they are; a row that lacks a feature
    has NULL impacts.
    """
    trees = as_ensemble(instances.sparkSession, fitted.model)
    names = fitted.names
    rows = instances.select(*key, _vector(names).alias("_x"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_impact", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(len(key)).flatten().fill_null(np.nan)).reshape(-1, len(names))
            out = np.where(np.isnan(x).any(axis=1)[:, None], np.nan, trees.shapley(np.nan_to_num(x)))
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_impact"])

    items = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_x").alias("value"), F.col("_impact").alias("impact"))
    return rows.mapInArrow(run, schema).select(*key, F.inline(items))


def importance(attributions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean size and mean of the attributions per feature, ranked by size."""
    by = by or []
    out = attributions.groupBy(*by, "feature").agg(
        F.avg(F.abs("impact")).alias("mean_abs"), F.avg("impact").alias("mean_impact")
    )
    # One row per feature: the window is as small as the feature list.
    w = Window.partitionBy(*by).orderBy(F.col("mean_abs").desc(), "feature")
    return out.withColumn("rank", F.rank().over(w))


def _normal(i: Column, *key: Column | str) -> Column:
    """A standard normal value fixed by the key: the same one when a task is run again."""

    def uniform(salt: int) -> Column:
        spread = F.pmod(F.xxhash64(F.lit(salt), *key, i), F.lit(1 << 52)).cast("double")
        return (spread + 1.0) / F.lit(float((1 << 52) + 1))

    return F.sqrt(F.lit(-2.0) * F.log(uniform(1))) * F.cos(F.lit(2 * np.pi) * uniform(2))


def lime(
    instances: DataFrame, fitted: Fitted, key: list[str], samples: int = 5000, num_features: int = TOP, seed: int = 42
) -> DataFrame:
    """Local linear surrogate of the model around each instance.

    Draws ``samples`` points per instance in the scaled space, weighs them by
    their distance, and fits a ridge regression per instance. A group is
    ``samples`` rows, whatever the size of the data.
    """
    names = fitted.names
    width = 0.75 * np.sqrt(len(names))
    index = F.sequence(F.lit(0), F.lit(len(names) - 1))
    drawn = _dealt(instances.select(*key, *names), key).select(
        *key, _vector(names).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_s")
    )
    # The first point is the instance itself.
    points = drawn.withColumn(
        "_p",
        F.when(F.col("_s") == 0, F.col("_x")).otherwise(F.transform(index, lambda i: _normal(i, F.lit(seed), *key, "_s"))),
    )
    square = F.aggregate(F.zip_with("_p", "_x", lambda p, x: (p - x) * (p - x)), F.lit(0.0), lambda a, d: a + d)
    scored = fitted.model.transform(
        points.withColumns({"_w": F.sqrt(F.exp(-square / F.lit(float(width**2)))), VECTOR: array_to_vector(F.col("_p"))})
    ).select(*key, "_s", "_p", "_w", F.col("prediction").alias("_y"))
    keep = [f.simpleString() for f in scored.select(*key).schema]
    schema = ", ".join(s.replace(":", " ", 1) for s in keep) + ", feature string, weight double, intercept double, local_prediction double"

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("_s")
        x, y, w = np.stack(batch["_p"].to_numpy()), batch["_y"].to_numpy(), batch["_w"].to_numpy()

        def ridge(x: np.ndarray) -> tuple[np.ndarray, float]:
            mx, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
            cx = x - mx
            coef = np.linalg.solve((cx.T * w) @ cx + np.eye(x.shape[1]), (cx.T * w) @ (y - my))
            return coef, my - mx @ coef

        # The features of the largest weights, then a fit on them alone.
        first, _ = ridge(x)
        top = np.argsort(-np.abs(first), kind="stable")[:num_features]
        coef, start = ridge(x[:, top])
        out = pd.DataFrame({"feature": [names[i] for i in top], "weight": coef})
        for c in key:
            out[c] = batch[c].iloc[0]
        return out.assign(intercept=start, local_prediction=start + x[0, top] @ coef)[[*key, "feature", "weight", "intercept", "local_prediction"]]

    return scored.groupBy(*key).applyInPandas(fit, schema)


def correlation_impact(df: DataFrame, features: list[str], target: str = "pm2_5") -> DataFrame:
    """Stand-in for attributions: scaled correlation with the target, 0 where undefined."""
    found = correlations_with(df, target, features)
    return found.select(STATION, "feature", (F.coalesce(F.col("r"), F.lit(0.0)) * FALLBACK_SCALE).alias("impact"))


def with_fallback(attributions: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fallback's impact for stations all of whose attributions are tiny."""
    silent = attributions.groupBy(STATION).agg((F.max(F.abs("impact")) < TINY).alias("is_heuristic"))
    other = fallback.select(STATION, "feature", F.col("impact").alias("_f"))
    return (
        attributions.join(silent, STATION)
        .join(other, [STATION, "feature"], "left")
        .withColumn("impact", F.when(F.col("is_heuristic"), F.coalesce("_f", F.lit(0.0))).otherwise(F.col("impact")))
        .drop("_f")
    )


def display_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DISPLAY_NAMES.items()), "feature string, display_name string")


def top_drivers(attributions: DataFrame, by: list[str] | None = None, n: int = TOP) -> DataFrame:
    """The features with the largest impact, named, with the direction they push."""
    by = by or [STATION]
    w = Window.partitionBy(*by).orderBy(F.abs("impact").desc(), "feature")
    names = F.broadcast(display_names(attributions.sparkSession))
    return (
        attributions.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= n)
        .join(names, "feature", "left")
        .select(
            *by,
            "place",
            F.coalesce("display_name", "feature").alias("feature"),
            "value",
            "impact",
            F.abs("impact").alias("abs_impact"),
            F.when(F.col("impact") > 0, F.lit(UP)).otherwise(F.lit(DOWN)).alias("direction"),
        )
    )
