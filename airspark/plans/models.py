"""Spark ML regressors: fitting, random search, the model registry, scoring."""

from __future__ import annotations

import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, functions as F

from airspark.plans.dataset import Scaler, contiguous_folds
from airspark.plans.ensemble import compiled
from airspark.plans.margin import margin_search
from airspark.schema import STATION, TS

SEED = 42
VECTOR = "features"

# Settings to draw from.
GBT_GRID = {
    "maxIter": [50, 100, 200, 300, 500],
    "maxDepth": [3, 4, 5, 6, 7, 8],
    "stepSize": [0.01, 0.05, 0.1, 0.2, 0.3],
    "subsamplingRate": [0.6, 0.7, 0.8, 0.9, 1.0],
    "minInstancesPerNode": [1, 3, 5],
    "minInfoGain": [0.0, 0.1, 0.2, 0.3],
    "featureSubsetStrategy": ["0.6", "0.7", "0.8", "0.9", "1.0"],
}
RF_GRID = {
    "numTrees": [50, 100, 200, 300, 500],
    "maxDepth": [5, 10, 15, 20, 25],
    "minInstancesPerNode": [1, 2, 4, 8],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
    "bootstrap": [True, False],
}
#: The setting that says how many trees an ensemble has.
SIZES = ["maxIter", "numTrees"]
#: Least rows of a partition of training rows. Ensembles make a small job per level of every tree.
FIT_ROWS = 50_000
#: Partitions of training rows for each core. Every task of every pass of a fit reports to the
#: driver, so their number may not grow with the rows; partitions that outgrow memory go to disk.
FIT_WAVES = 2
HUBER_GRID = {"regParam": [0.0, 0.01, 0.1, 1.0], "epsilon": [1.05, 1.2, 1.35, 2.0]}
# Weights of the loss and widths of the margin.
LINEAR_GRID = {"C": [0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0], "epsilon": [0.0, 0.05, 0.1, 0.2, 0.5]}


def assemble(df: DataFrame, names: list[str], missing: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol=VECTOR, handleInvalid=missing).transform(df)


def gbt(**settings) -> GBTRegressor:
    return GBTRegressor(featuresCol=VECTOR, labelCol="target", seed=SEED, **settings)


def forest(**settings) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol=VECTOR, labelCol="target", seed=SEED, **settings)


def robust_linear(**settings) -> LinearRegression:
    """Linear regression with a loss that large errors cannot dominate."""
    settings = {"maxIter": 100, "tol": 1e-4, **settings}
    return LinearRegression(featuresCol=VECTOR, labelCol="target", loss="huber", **settings)


@dataclass(frozen=True)
class Fitted:
    """A model with what is needed to use it."""

    name: str
    model: Model
    names: list[str]
    scaler: Scaler

    def predict_scaled(self, df: DataFrame) -> DataFrame:
        return self.model.transform(assemble(df, self.names)).drop(VECTOR)

    def predict(self, df: DataFrame) -> DataFrame:
        """Predict rows of unscaled features; a row that lacks one gets NULL."""
        scaled = self.scaler.transform(df.select(STATION, TS, *self.names))
        whole = reduce(and_, [F.col(n).isNotNull() for n in self.names])
        guessed = self.model.transform(assemble(scaled, self.names, "keep"))
        return guessed.select(STATION, TS, F.when(whole, F.col("prediction")).alias("prediction"))


def packed(rows: DataFrame) -> DataFrame:
    """Rows kept in memory and on disk, few partitions where there are few rows, and never more than the cores need."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    parts = max(1, min(-(-kept.count() // FIT_ROWS), FIT_WAVES * rows.sparkSession.sparkContext.defaultParallelism))
    if parts >= kept.rdd.getNumPartitions():
        return kept
    few = rows.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    few.count()
    kept.unpersist()
    return few


def fit(name: str, estimator, train: DataFrame, names: list[str], scaler: Scaler) -> Fitted:
    """Fit on scaled training rows, which are kept only while iterating over them."""
    rows = packed(assemble(train, names).select(VECTOR, "target"))
    try:
        return Fitted(name, estimator.fit(rows), names, scaler)
    finally:
        rows.unpersist()


def _drawn(grid: dict[str, list], n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    total = 1
    for values in grid.values():
        total *= len(values)
    chosen: list[dict] = []
    while len(chosen) < min(n, total):
        pick = {k: rng.choice(v) for k, v in grid.items()}
        if pick not in chosen:
            chosen.append(pick)
    return chosen


def draw_settings(estimator, grid: dict[str, list], n: int, seed: int = SEED) -> list[dict]:
    """``n`` different settings drawn from the grid, the same ones for the same seed."""
    return [{estimator.getParam(k): v for k, v in pick.items()} for pick in _drawn(grid, n, seed)]


def draw_families(grid: dict[str, list], size: str, n: int, seed: int = SEED) -> list[dict]:
    """``n`` settings in families that differ in their number of trees alone.

    Each of the drawn families has every size of the grid, the last one as many as are left.
    """
    rest = {k: v for k, v in grid.items() if k != size}
    families = _drawn(rest, -(-n // len(grid[size])), seed)
    return [{**f, size: v} for f in families for v in sorted(grid[size])][:n]


def _squares_of_firsts(rows: DataFrame, model: Model, sizes: list[int]) -> tuple[int, list[float]]:
    """How many rows there are, and the squared errors of the first trees alone, per size, in one pass."""
    trees, mean = compiled(rows.sparkSession, model), "RandomForest" in type(model).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(sizes))
        for batch in batches:
            y = np.asarray(batch.column("y"))
            x = np.asarray(batch.column("x").flatten()).reshape(len(y), -1)
            n, total = n + len(y), total + ((trees.predict_first(x, sizes, mean) - y[:, None]) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "squares"])

    parts = rows.select(vector_to_array(VECTOR).alias("x"), F.col("target").alias("y")).mapInArrow(run, "n long, squares array<double>")
    row = parts.agg(F.sum("n").alias("n"), *[F.sum(F.get("squares", F.lit(i))).alias(f"s{i}") for i in range(len(sizes))]).first()
    return row["n"] or 0, [row[f"s{i}"] for i in range(len(sizes))]


def shared_search(estimator, settings: list[dict], size: str, rows: DataFrame, folds: int, parallelism: int) -> list[float]:
    """The mean error over the folds of every setting, from one fit per fold and family.

    The first trees of a large ensemble are a smaller one: for boosting the very one that
    the smaller number would give, for forests one with other random draws. So settings
    that differ in their number of trees alone share the fit of the largest.
    """
    families: dict[tuple, list[int]] = {}
    for i, s in enumerate(settings):
        families.setdefault(tuple((k, v) for k, v in s.items() if k != size), []).append(i)
    fold_rows = [(packed(rows.where(F.col("fold") != f)), rows.where(F.col("fold") == f)) for f in range(folds)]

    def run(task: tuple[int, tuple]) -> dict[int, float]:
        fold, family = task
        members = families[family]
        sizes = [settings[i][size] for i in members]
        params = {estimator.getParam(k): v for k, v in [*family, (size, max(sizes))]}
        n, squares = _squares_of_firsts(fold_rows[fold][1], estimator.fit(fold_rows[fold][0], params), sizes)
        return {i: (s / n) ** 0.5 for i, s in zip(members, squares)} if n else {}

    tasks = [(f, family) for family in families for f in range(folds)]
    spark = rows.sparkSession
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            found = list(pool.map(inheritable_thread_target(spark)(run), tasks))
    finally:
        for train, _ in fold_rows:
            train.unpersist()
    scores = [[errors[i] for errors in found if i in errors] for i in range(len(settings))]
    return [sum(s) / len(s) if s else float("nan") for s in scores]


def random_search(
    name: str,
    estimator,
    grid: dict[str, list],
    train: DataFrame,
    names: list[str],
    scaler: Scaler,
    n_iter: int = 20,
    folds: int = 3,
    parallelism: int = 8,
) -> tuple[Fitted, list[dict]]:
    """Random search over consecutive folds of all training rows; the winner is fitted on them.

    Ensembles are drawn and scored in families that share their fits (``shared_search``).
    """
    rows = packed(assemble(contiguous_folds(train, folds), names).select(VECTOR, "target", "fold"))
    size = next((s for s in SIZES if s in grid), None)
    try:
        if size:
            drawn = draw_families(grid, size, n_iter)
            scores = shared_search(estimator, drawn, size, rows, folds, parallelism)
            best = drawn[int(np.nanargmin(scores))]
            model = estimator.fit(rows, {estimator.getParam(k): v for k, v in best.items()})
        else:
            settings = draw_settings(estimator, grid, n_iter)
            search = CrossValidator(
                estimator=estimator,
                estimatorParamMaps=settings,
                evaluator=RegressionEvaluator(labelCol="target", metricName="rmse"),
                numFolds=folds,
                foldCol="fold",
                parallelism=parallelism,
            )
            found = search.fit(rows)
            drawn, scores, model = [{p.name: v for p, v in s.items()} for s in settings], found.avgMetrics, found.bestModel
    finally:
        rows.unpersist()
    report = [{"settings": ", ".join(f"{p}={v}" for p, v in s.items()), "rmse": float(m)} for s, m in zip(drawn, scores)]
    return Fitted(name, model, names, scaler), report


def tuned_margin(name: str, train: DataFrame, names: list[str], scaler: Scaler, n_iter: int = 15, folds: int = 3) -> tuple[Fitted, list[dict]]:
    """Epsilon-insensitive linear regression; all draws and folds are fitted in the same passes."""
    rows = packed(assemble(contiguous_folds(train, folds), names).select(VECTOR, "target", "fold"))
    drawn = _drawn(LINEAR_GRID, n_iter, SEED)
    try:
        model, errors = margin_search(rows, drawn, folds)
    finally:
        rows.unpersist()
    report = [{"settings": ", ".join(f"{k}={v}" for k, v in s.items()), "rmse": e} for s, e in zip(drawn, errors)]
    return Fitted(name, model, names, scaler), report


def tuned(name: str, train: DataFrame, names: list[str], scaler: Scaler, n_iter: int | None = None, folds: int = 3) -> tuple[Fitted, list[dict]]:
    """A listed model with settings found by random search over its grid."""
    if name == "robust_linear":
        return tuned_margin(name, train, names, scaler, n_iter or 15, folds)
    estimator, grid, draws = {"gbt": (gbt(), GBT_GRID, 25), "forest": (forest(), RF_GRID, 25)}[name]
    return random_search(name, estimator, grid, train, names, scaler, n_iter or draws, folds)


def raw_weights(fitted: Fitted) -> tuple[float, dict[str, float]]:
    """Intercept and weights of a linear model for unscaled features."""
    model: LinearRegressionModel = fitted.model
    weights, start = {}, float(model.intercept)
    for name, coef in zip(fitted.names, model.coefficients):
        weights[name] = float(coef) / fitted.scaler.divisor(name)
        start -= weights[name] * (fitted.scaler.mean[name] or 0.0)
    return start, weights


# ---- registry -------------------------------------------------------------


def register(spark: SparkSession, root: str, fitted: Fitted, metrics: dict[str, float]) -> int:
    """Save a model, its scaler and its scores under the next version."""
    known = registry(spark, root)
    version = 1 if known is None else known.agg(F.max("version")).first()[0] + 1
    fitted.model.write().save(f"{root}/models/version={version}")
    scaler = [
        (version, i, n, fitted.scaler.mean[n], fitted.scaler.std[n]) for i, n in enumerate(fitted.names)
    ]
    spark.createDataFrame(scaler, "version int, position int, feature string, mean double, std double").coalesce(
        1
    ).write.mode("append").parquet(f"{root}/scalers")
    row = [(version, fitted.name, *[float(metrics[m]) for m in ("rmse", "mae", "r2")])]
    # The registry row comes last: a version counts once all its parts are there.
    spark.createDataFrame(row, "version int, model string, rmse double, mae double, r2 double").coalesce(1).write.mode(
        "append"
    ).parquet(f"{root}/registry")
    return version


def registry(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/registry")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load(spark: SparkSession, root: str, loader, version: int | None = None) -> Fitted:
    """The newest version, or the one asked for. ``loader`` is the model class."""
    table = registry(spark, root)
    version = version or table.agg(F.max("version")).first()[0]
    name = table.where(F.col("version") == version).first()["model"]
    rows = spark.read.parquet(f"{root}/scalers").where(F.col("version") == version).orderBy("position").collect()
    scaler = Scaler({r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["std"] for r in rows})
    return Fitted(name, loader.load(f"{root}/models/version={version}"), [r["feature"] for r in rows], scaler)
