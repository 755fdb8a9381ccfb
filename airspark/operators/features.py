"""Model features: lags, differences, rolling statistics, clock and calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from airspark.functions.numbers import mean_present
from airspark.functions.timefn import cyclic, is_weekend
from airspark.operators.series import row_windowed
from airspark.schema import TS

LAGS = (1, 2, 3, 24, 48, 72)
DAILY_LAGS = (24, 48, 72)
ROLLING = 24


def time_parts(df: DataFrame, ts: str = TS) -> DataFrame:
    t = F.col(ts)
    return df.withColumns({"hour": F.hour(t), "day": F.dayofmonth(t), "month": F.month(t)})


def cyclical_time(df: DataFrame) -> DataFrame:
    hour_sin, hour_cos = cyclic(F.col("hour"), 24)
    month_sin, month_cos = cyclic(F.col("month"), 12)
    return df.withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "hour_raw": F.col("hour"),
        }
    )


def weekend_flag(df: DataFrame, ts: str = TS) -> DataFrame:
    return df.withColumn("is_weekend", is_weekend(F.col(ts)))


def lag_columns(w: WindowSpec, value: str = "pm2_5") -> dict[str, Column]:
    return {f"{value}_lag{k}": F.lag(value, k).over(w) for k in LAGS}


def diff_columns(w: WindowSpec, value: str = "pm2_5") -> dict[str, Column]:
    x, one, two, day = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w), F.lag(value, 24).over(w)
    return {"diff_1h": x - one, "diff_24h": x - day, "diff_1h_acc": (x - one) - (one - two)}


def recent_hour_avg(w: WindowSpec, value: str = "pm2_5") -> dict[str, Column]:
    return {"recent_hour_avg": mean_present(*[F.lag(value, k).over(w) for k in DAILY_LAGS])}


def rolling_columns(w: WindowSpec, value: str = "pm2_5", rows: int = ROLLING) -> dict[str, Column]:
    frame = w.rowsBetween(-(rows - 1), Window.currentRow)
    full = F.count(value).over(frame) == rows
    return {
        f"{value}_rolling_mean_{rows}h": F.when(full, F.avg(value).over(frame)),
        f"{value}_rolling_std_{rows}h": F.when(full, F.stddev_samp(value).over(frame)),
    }


def target_columns(w: WindowSpec, value: str = "pm2_5") -> dict[str, Column]:
    return {f"{value}_next": F.lead(value, 1).over(w), f"{value}_3day": F.lead(value, 72).over(w)}


def lag_features(df: DataFrame, **how) -> DataFrame:
    return row_windowed(df, lag_columns, before=max(LAGS), **how)


def diff_features(df: DataFrame, **how) -> DataFrame:
    return row_windowed(df, diff_columns, before=24, **how)


def hour_profile(df: DataFrame, **how) -> DataFrame:
    return row_windowed(df, recent_hour_avg, before=max(DAILY_LAGS), **how)


def rolling_features(df: DataFrame, **how) -> DataFrame:
    return row_windowed(df, rolling_columns, before=ROLLING - 1, **how)


def targets(df: DataFrame, **how) -> DataFrame:
    return row_windowed(df, target_columns, after=72, **how)


def _history_columns(w: WindowSpec) -> dict[str, Column]:
    return {**lag_columns(w), **diff_columns(w), **recent_hour_avg(w), **rolling_columns(w)}


def full_features(df: DataFrame, target: str | None = None, **how) -> DataFrame:
    """All features in one ordered pass; ``target`` adds the value to learn.

    ``target`` is ``"recursive"`` (one row ahead) or ``"direct"`` (72 rows).
    """
    ahead = {None: 0, "recursive": 1, "direct": 72}[target]

    def build(w: WindowSpec) -> dict[str, Column]:
        columns = _history_columns(w)
        if ahead:
            columns["target"] = F.lead("pm2_5", ahead).over(w)
        return columns

    return weekend_flag(cyclical_time(row_windowed(df, build, before=72, after=ahead, **how)))
