"""Features at prediction time, from the last 72 values of each station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airspark.functions.numbers import ratio
from airspark.functions.timefn import add_hours, cyclic, instant, is_weekend
from airspark.operators.series import last_rows
from airspark.schema import POLLUTANTS, STATION, TS

KEEP = 72


def recent_state(df: DataFrame, now, rate: str | None = "aqi_change_rate", history_includes_current: bool = True) -> DataFrame:
    """One row per station: the newest actual row and the values leading to it.

    ``hist`` holds at most 72 values, oldest first. It ends with the current
    value unless ``history_includes_current`` is off.
    """
    extra = [c for c in (rate, "aqi") if c and c in df.columns]
    past = df.where(F.col(TS) <= instant(df, now)).select(STATION, TS, *POLLUTANTS, *extra)
    newest = last_rows(past, KEEP if history_includes_current else KEEP + 1, rank="_r")
    first = 1 if history_includes_current else 2
    values = F.collect_list(F.when(F.col("_r") >= first, F.struct(F.col(TS), F.col("pm2_5"))))
    current = F.max(F.when(F.col("_r") == 1, F.struct(TS, *POLLUTANTS, *extra)))
    return (
        newest.groupBy(STATION)
        .agg(F.array_sort(values)["pm2_5"].alias("hist"), current.alias("_c"))
        .select(STATION, F.col("_c.*"), "hist")
    )


def day_sums(hist: Column) -> tuple[Column, Column]:
    """Sum and sum of squares of the last 24 values, or of all if there are fewer."""
    last_day = F.slice(hist, F.greatest(F.size(hist) - 23, F.lit(1)), F.lit(24))
    zero = F.lit(0.0)
    return F.aggregate(last_day, zero, lambda a, x: a + x), F.aggregate(last_day, zero, lambda a, x: a + x * x)


def calendar_columns(at: Column) -> dict[str, Column]:
    """Features that only depend on the hour described."""
    hour, month = F.hour(at), F.month(at)
    hour_sin, hour_cos = cyclic(hour, 24)
    month_sin, month_cos = cyclic(month, 12)
    return {
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "hour_raw": hour,
        "month_sin": month_sin,
        "month_cos": month_cos,
        "month": month,
        "day": F.dayofmonth(at),
        "is_weekend": is_weekend(at),
    }


def history_columns(
    hist: Column, current: dict[str, Column], sums: tuple[Column, Column] | None = None
) -> dict[str, Column]:
    """Features of the values up to now.

    ``current`` maps the pollutants, and the change rate if known, to the
    current values. ``sums`` gives ``day_sums`` where the caller keeps them up
    to date itself.
    """
    now = current["pm2_5"]
    n = F.size(hist)

    def back(k: int) -> Column:
        return F.try_element_at(hist, F.lit(-k))

    long, day = n >= KEEP, n >= 24
    out = {p: current[p] for p in POLLUTANTS}
    for k in (1, 2, 3, 24, 48, 72):
        out[f"pm2_5_lag{k}"] = F.when(long, back(k)).otherwise(now)
    zero = F.lit(0.0)
    out["diff_1h"] = F.when(day, now - back(1)).otherwise(zero)
    out["diff_24h"] = F.when(day, now - back(24)).otherwise(zero)
    out["diff_1h_acc"] = F.when(day, (now - back(1)) - (back(1) - back(2))).otherwise(zero)
    out["recent_hour_avg"] = (out["pm2_5_lag24"] + out["pm2_5_lag48"] + out["pm2_5_lag72"]) / 3.0
    total, squares = sums or day_sums(hist)
    mean = total / 24.0
    variance = F.greatest(squares / 24.0 - mean * mean, zero) * (24.0 / 23.0)
    out["pm2_5_rolling_mean_24h"] = F.when(day, mean).otherwise(now)
    out["pm2_5_rolling_std_24h"] = F.when(day, F.sqrt(variance)).otherwise(zero)
    if "aqi_change_rate" in current:
        out["aqi_change_rate"] = current["aqi_change_rate"]
    else:
        previous = back(1)
        rate = F.when(previous > 0, ratio(now - previous, previous)).otherwise(zero)
        out["aqi_change_rate"] = F.when(n >= 2, rate).otherwise(zero)
    return out


def serving_columns(hist: Column, current: dict[str, Column], at: Column) -> dict[str, Column]:
    """All features of one prediction; ``at`` is the hour the calendar features describe."""
    return {**history_columns(hist, current), **calendar_columns(at)}


def serving_features(state: DataFrame, ahead_hours: int = 1) -> DataFrame:
    """Features of each station for the hour ``ahead_hours`` after its current row."""
    names = [*POLLUTANTS] + (["aqi_change_rate"] if "aqi_change_rate" in state.columns else [])
    at = add_hours(F.col(TS), F.lit(ahead_hours))
    columns = serving_columns(F.col("hist"), {p: F.col(p) for p in names}, at)
    return state.select(STATION, TS, at.alias("target_ts"), *[c.alias(n) for n, c in columns.items()])
