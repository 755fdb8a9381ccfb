"""The training job: one data set, several models, one winner in the registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from airspark.operators.univariate import fit_harmonic, fit_seasonal_ar, harmonic_predict, seasonal_ar_forecast
from airspark.plans import models
from airspark.plans.dataset import TRAIN_SHARE, Scaler, chrono_split, labelled, scaled_set
from airspark.plans.evaluate import pick_winner, regression_metrics
from airspark.plans.forecast import backtest_t72
from airspark.schema import STATION, TS
from airspark.session import written

LISTED = ["gbt", "forest", "robust_linear", "seasonal_ar", "harmonic"]


#: Learned models that are tuned unless settings are given.
TUNED = ["gbt", "forest", "robust_linear"]


class StationModel:
    """Coefficients of a per-station model, one row each, stored like any other model."""

    def __init__(self, table: DataFrame):
        self.table = table

    def write(self) -> "StationModel":
        return self

    def save(self, path: str) -> None:
        self.table.write.parquet(path)

    @staticmethod
    def load(path: str) -> "StationModel":
        return StationModel(SparkSession.active().read.parquet(path))


def series_models(rows: DataFrame) -> dict[str, DataFrame]:
    """The two per-station models, fitted on the training rows."""
    train = rows.where("is_train").select(STATION, TS, "pm2_5")
    return {"seasonal_ar": written(fit_seasonal_ar(train), "seasonal"), "harmonic": written(fit_harmonic(train), "harmonic")}


def series_scores(rows: DataFrame, fits: dict[str, DataFrame]) -> DataFrame:
    """Scores of the two per-station models over the same test rows."""
    train = rows.where("is_train").select(STATION, TS, "pm2_5")
    test = rows.where(~F.col("is_train")).select(STATION, TS, "pm2_5", (F.col("rn") - F.floor(F.lit(TRAIN_SHARE) * F.col("rn_total"))).alias("step"))
    longest = test.agg(F.max("step")).first()[0] or 0
    ahead = seasonal_ar_forecast(train, fits["seasonal_ar"], int(longest))
    seasonal = test.join(ahead, [STATION, "step"]).withColumn("model", F.lit("seasonal_ar"))
    cycles = harmonic_predict(test, fits["harmonic"]).withColumn("model", F.lit("harmonic"))
    both = seasonal.select("model", "pm2_5", "predicted").unionByName(cycles.select("model", "pm2_5", "predicted"))
    return regression_metrics(both.withColumnRenamed("pm2_5", "actual"), ["model"])


def train_and_compare(
    df: DataFrame, root: str | None = None, chosen: dict[str, object] | None = None, last: int | None = None, all_eligible: bool = False
) -> tuple[DataFrame, int | None]:
    """Fit the models, score them on held-out rows, and register the winner under ``root``.

    Settings of the learned models are searched (``models.tuned``) unless estimators are
    ``chosen``. Learned models are scored 72 hours ahead from the last ``last`` test origins
    of each station (all of them with ``None``); the per-station models over the
    whole test part. The winner is a learned model unless ``all_eligible``, which lets the
    per-station ones win, too; their coefficients are stored as a table.
    """
    rows = written(chrono_split(labelled(df)), "labelled")
    scaled, names, scaler = scaled_set(rows)
    train = scaled.where("is_train")
    if chosen:
        fitted = {n: models.fit(n, e, train, names, scaler) for n, e in chosen.items()}
    else:
        fitted = {n: models.tuned(n, train, names, scaler)[0] for n in TUNED}
    series = series_models(rows)
    scores = [backtest_t72(rows, ~F.col("is_train"), f, last) for f in fitted.values()]
    # Each score is one row; they are computed once and then used several times.
    table = written(reduce(DataFrame.unionByName, [*scores, series_scores(rows, series)]), "scores")
    version = None
    if root is not None:
        if all_eligible:
            fitted |= {n: models.Fitted(n, StationModel(t), [], Scaler({}, {})) for n, t in series.items()}
        best = pick_winner(table.where(F.col("model").isin(list(fitted))), LISTED).first()
        version = models.register(df.sparkSession, root, fitted[best["model"]], best.asDict())
    return table, version
