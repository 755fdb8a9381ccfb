"""Scores of predictions, the choice of a winner, and words for the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airspark.functions import labels
from airspark.functions.numbers import ratio
from airspark.functions.timefn import HOUR_US
from airspark.operators.series import range_windowed
from airspark.schema import STATION


def actual_ahead(df: DataFrame, hours: int = 72, value: str = "pm2_5", name: str = "actual_t72") -> DataFrame:
    """The value exactly ``hours`` later, or the row's own value where there is none."""
    reach = hours * HOUR_US

    def build(w):
        return {"_ahead": F.first(F.struct(F.col(value).alias("v"))).over(w.rangeBetween(reach, reach))}

    out = range_windowed(df, build, after_us=reach)
    found = F.when(F.col("_ahead").isNotNull(), F.col("_ahead.v")).otherwise(F.col(value))
    return out.withColumn(name, found).drop("_ahead")


def regression_metrics(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and R² in one pass with map-side sums."""
    a, p = F.col(actual), F.col(predicted)
    # Conditions inside the aggregates instead of a filter: a filter on the
    # prediction would be pushed down and compute costly predictions twice.
    scored = df.withColumns({"_e": a - p, "_a": F.when(p.isNotNull(), a)})
    return (
        scored.groupBy(*by)
        .agg(
            F.count("_e").alias("n"),
            F.avg(F.abs("_e")).alias("mae"),
            F.avg(F.col("_e") * F.col("_e")).alias("_mse"),
            F.when(F.min("_a") < F.max("_a"), F.var_pop("_a")).alias("_var"),
        )
        .where(F.col("n") > 0)
        .withColumns({"rmse": F.sqrt("_mse"), "r2": F.lit(1.0) - ratio(F.col("_mse"), F.col("_var"))})
        .drop("_mse", "_var")
    )


def pick_winner(metrics: DataFrame, listed: list[str], by: list[str] | None = None, model: str = "model") -> DataFrame:
    """Lowest RMSE; of equals, the one listed first."""
    order = F.array_position(F.array(*[F.lit(m) for m in listed]), F.col(model))
    w = Window.partitionBy(*(by or [])).orderBy("rmse", order) if by else Window.orderBy("rmse", order)
    return metrics.withColumn("_w", F.row_number().over(w)).where(F.col("_w") == 1).drop("_w")


def with_confidence(metrics: DataFrame) -> DataFrame:
    score = labels.confidence(F.col("r2"), F.col("rmse"), F.col("mae"))
    return metrics.withColumns(
        {
            "confidence": F.round(score, 1),
            "level": labels.at_least(score, labels.CONFIDENCE_WORDS, labels.CONFIDENCE_FLOOR),
        }
    )


def with_display_accuracy(metrics: DataFrame) -> DataFrame:
    shown = F.round(labels.display_accuracy(F.col("rmse")), 1)
    return metrics.withColumns(
        {"accuracy": shown, "accuracy_level": labels.at_least(shown, labels.ACCURACY_WORDS, labels.ACCURACY_FLOOR)}
    )


def live_scores(df: DataFrame, by: list[str] | None = None, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Hold-out scores with an accuracy from the mean relative error; a zero actual counts as 1."""
    by = by or [STATION]
    a, p = F.col(actual), F.col(predicted)
    relative = F.abs((a - p) / F.when(a == 0, F.lit(1.0)).otherwise(a))
    mape = df.groupBy(*by).agg((F.avg(relative) * 100).alias("mape"))
    accuracy = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("mape"))
    return regression_metrics(df, by, actual, predicted).join(mape, by).withColumn("accuracy", accuracy)
