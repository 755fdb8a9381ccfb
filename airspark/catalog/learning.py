"""Feature, training-set, forecast and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airspark import fixtures as fx
from airspark.catalog.registry import q6, query, rounded
from airspark.catalog.sql import NOW_SQL, OBS, TIMED, WITH_AQI, pm_aqi_sql
from airspark.catalog.summaries import RATED, union_all
from airspark.functions.timefn import instant
from airspark.operators import features
from airspark.operators.changerate import change_rate_asof
from airspark.plans import dataset, evaluate, outlook, serving
from airspark.schema import FEATURES, POLLUTANTS

P = POLLUTANTS
W = "over (partition by station_id order by ts)"
LAG_SQL = ", ".join(f"lag(pm2_5, {k}) {W} pm2_5_lag{k}" for k in features.LAGS)
DIFF_SQL = (
    f"pm2_5 - lag(pm2_5, 1) {W} diff_1h, pm2_5 - lag(pm2_5, 24) {W} diff_24h,"
    f" (pm2_5 - lag(pm2_5, 1) {W}) - (lag(pm2_5, 1) {W} - lag(pm2_5, 2) {W}) diff_1h_acc"
)
_DAILY = [f"lag(pm2_5, {k}) {W}" for k in features.DAILY_LAGS]
HOUR_AVG_SQL = f"list_avg(list_filter([{', '.join(_DAILY)}], lambda x: x is not null)) recent_hour_avg"
_F24 = "over (partition by station_id order by ts rows between 23 preceding and current row)"
ROLL_SQL = (
    f"case when count(pm2_5) {_F24} = 24 then avg(pm2_5) {_F24} end pm2_5_rolling_mean_24h,"
    f" case when count(pm2_5) {_F24} = 24 then stddev_samp(pm2_5) {_F24} end pm2_5_rolling_std_24h"
)
CLOCK_SQL = (
    "sin(2 * pi() * hour / 24) hour_sin, cos(2 * pi() * hour / 24) hour_cos, sin(2 * pi() * month / 12) month_sin,"
    " cos(2 * pi() * month / 12) month_cos, hour hour_raw, cast(isodow(ts) >= 6 as int) is_weekend"
)
FULL_SQL = f"{RATED}, f as (select *, {LAG_SQL}, {DIFF_SQL}, {HOUR_AVG_SQL}, {ROLL_SQL}, {CLOCK_SQL}, lead(pm2_5, 1) {W} target from rated)"
INPUTS = [*FEATURES, "aqi_change_rate"]
_WHOLE = {"hour_raw", "month", "day", "is_weekend"}
_FULL_NULLS = " and ".join(f"{c} is not null" for c in ["pm10", "no2", "target", *[f"pm2_5_lag{k}" for k in features.LAGS],
                                                         "pm2_5_rolling_std_24h", "diff_1h_acc"])
LABELLED_SQL = f"{FULL_SQL}, s as (select * from f where {_FULL_NULLS})"


def shown(columns) -> str:
    return ", ".join(c if c in _WHOLE else f"{q6(c)} {c}" for c in columns)


def rated(spark, sf_dir):
    """Observations with calendar parts, index and change rate."""
    return change_rate_asof(fx.with_aqi(spark, sf_dir)).drop("prev_aqi")


# ---- windows --------------------------------------------------------------

def _window_sql(columns: str, names) -> str:
    return f"with {OBS}, f as (select station_id, ts, {columns} from obs) select station_id, ts, {shown(names)} from f"


def _windowed(fn, names):
    def run(spark, sf_dir):
        return rounded(fn(fx.observations(spark, sf_dir).select("station_id", "ts", "pm2_5")).select("station_id", "ts", *names), *names)

    return run


_LAGS = [f"pm2_5_lag{k}" for k in features.LAGS]
_DIFFS = ["diff_1h", "diff_24h", "diff_1h_acc"]
_ROLLS = ["pm2_5_rolling_mean_24h", "pm2_5_rolling_std_24h"]
_TARGETS = ["pm2_5_next", "pm2_5_3day"]
query(_window_sql(LAG_SQL, _LAGS), "lag_features")(_windowed(features.lag_features, _LAGS))
query(_window_sql(DIFF_SQL, _DIFFS), "diff_features")(_windowed(features.diff_features, _DIFFS))
query(_window_sql(HOUR_AVG_SQL, ["recent_hour_avg"]), "recent_hour_avg")(_windowed(features.hour_profile, ["recent_hour_avg"]))
query(_window_sql(ROLL_SQL, _ROLLS), "rolling_24")(_windowed(features.rolling_features, _ROLLS))
query(_window_sql(f"lead(pm2_5, 1) {W} pm2_5_next, lead(pm2_5, 72) {W} pm2_5_3day", _TARGETS), "targets")(_windowed(features.targets, _TARGETS))


@query(f"with {FULL_SQL} select station_id, ts, {shown(INPUTS)} from f")
def features_full(spark, sf_dir):
    out = features.full_features(rated(spark, sf_dir)).select("station_id", "ts", *INPUTS)
    return rounded(out, *[c for c in INPUTS if c not in _WHOLE])


@query(f"with {LABELLED_SQL} select station_id, ts, {shown(INPUTS)} from s")
def feature_select(spark, sf_dir):
    rows = dataset.labelled(rated(spark, sf_dir))
    out = rows.select("station_id", "ts", *dataset.feature_select(rows))
    return rounded(out, *[c for c in INPUTS if c not in _WHOLE])


# ---- training set ---------------------------------------------------------

@query(f"with {OBS}, n as (select station_id, ts, row_number() {W} rn, count(*) over (partition by station_id) c from obs),"
       " k as (select *, floor(0.8::double * c) t from n)"
       " select station_id, ts, rn, c rn_total, rn <= t is_train, rn <= floor(0.8::double * t) is_tuning from k")
def chrono_split(spark, sf_dir):
    return dataset.chrono_split(fx.observations(spark, sf_dir).select("station_id", "ts"))


def _scaled(c: str) -> str:
    return f"{q6(f'({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1)')} as {c}"


@query(f"with {OBS} select station_id, ts, {', '.join(_scaled(p) for p in P)} from obs")
def scale_features(spark, sf_dir):
    obs = fx.observations(spark, sf_dir)
    return rounded(dataset.Scaler.fit(obs, P).transform(obs), *P)


@query(f"with {LABELLED_SQL} select station_id, ts, {', '.join(_scaled(c) for c in INPUTS)}, {q6('target')} target from s")
def training_set(spark, sf_dir):
    rows, names, _ = dataset.training_set(rated(spark, sf_dir))
    return rounded(rows, *names, "target")


@query(f"with {OBS} select * from obs order by substr(md5('42|' || station_id::varchar || '|' || ts::varchar), 1, 13), station_id, ts limit 1000")
def sample_rows(spark, sf_dir):
    return dataset.sample_rows(fx.observations(spark, sf_dir), 1000)


def _state_sql(limit: str = NOW_SQL) -> str:
    return (
        f"{RATED}, n as (select *, row_number() over (partition by station_id order by ts desc) r from rated where ts <= {limit}),"
        " k as (select * from n where r <= 72)"
    )


def _back(k: int) -> str:
    return f"max(pm2_5) filter (r = {k})"


@query(f"with {_state_sql()}, g as (select station_id, count(*) n, max(ts) ts, {', '.join(f'max({p}) filter (r = 1) {p}' for p in P)}, max(aqi_change_rate) filter (r = 1) aqi_change_rate,"
       f" {', '.join(f'{_back(k)} b{k}' for k in (1, 2, 3, 24, 48, 72))}, avg(pm2_5) filter (r <= 24) m24, stddev_samp(pm2_5) filter (r <= 24) s24 from k group by 1),"
       " x as (select *, ts + interval '1 hour' t, " + ", ".join(f"case when n >= 72 then b{k} else pm2_5 end pm2_5_lag{k}" for k in (1, 2, 3, 24, 48, 72)) + " from g),"
       " y as (select *, case when n >= 24 then pm2_5 - b1 else 0 end diff_1h, case when n >= 24 then pm2_5 - b24 else 0 end diff_24h,"
       " case when n >= 24 then (pm2_5 - b1) - (b1 - b2) else 0 end diff_1h_acc, (pm2_5_lag24 + pm2_5_lag48 + pm2_5_lag72) / 3 recent_hour_avg,"
       " case when n >= 24 then m24 else pm2_5 end pm2_5_rolling_mean_24h, case when n >= 24 then s24 else 0 end pm2_5_rolling_std_24h,"
       " sin(2 * pi() * hour(t) / 24) hour_sin, cos(2 * pi() * hour(t) / 24) hour_cos, cast(hour(t) as int) hour_raw, sin(2 * pi() * month(t) / 12) month_sin,"
       " cos(2 * pi() * month(t) / 12) month_cos, cast(month(t) as int) \"month\", cast(day(t) as int) \"day\", cast(isodow(t) >= 6 as int) is_weekend from x)"
       f" select station_id, ts, t target_ts, {shown(INPUTS)} from y")
def serving_features(spark, sf_dir):
    out = serving.serving_features(serving.recent_state(rated(spark, sf_dir), fx.NOW))
    return rounded(out, *[c for c in INPUTS if c not in _WHOLE])


# ---- forecasts without a model --------------------------------------------

MIRROR_SQL = (
    f"{WITH_AQI}, n as (select *, row_number() over (partition by station_id order by ts desc) r, count(*) over (partition by station_id) c from a where ts <= {NOW_SQL}),"
    " h as (select *, least(c, 72) m from n where r <= 72), cur as (select station_id, ts data_time, pm2_5 now, coalesce(aqi, 0) current_aqi, m from h where r = 1),"
    " z as (select cur.*, h.pm2_5 last from cur join h on h.station_id = cur.station_id and h.m - h.r = 71 % h.m),"
    " st as (select z.*, unnest(range(1, 73)) step from z), v as (select st.station_id, cast(step as int) step, data_time, current_aqi,"
    " greatest(5.0::double, h.pm2_5 + (now - last) * pow(0.8::double, step)) pm from st join h on h.station_id = st.station_id and h.m - h.r = (step - 1) % st.m),"
    f" mf as (select station_id, step, data_time + to_hours(step) ts, pm pm2_5, {pm_aqi_sql('pm')} aqi, current_aqi, data_time from v)"
)


def mirrored(spark, sf_dir):
    return outlook.mirror_forecast(fx.with_aqi(spark, sf_dir), fx.NOW)


@query(f"with {MIRROR_SQL} select station_id, step, ts, {q6('pm2_5')} pm2_5, aqi, current_aqi, data_time from mf")
def mirror_forecast(spark, sf_dir):
    return rounded(mirrored(spark, sf_dir), "pm2_5")


@query(f"with {MIRROR_SQL} select station_id, step, case step when 24 then 'Tomorrow' when 48 then 'In 2 Days' else 'In 3 Days' end card, aqi,"
       " aqi - current_aqi delta, case when aqi <= 50 then 'Good' when aqi <= 100 then 'Moderate' when aqi <= 150 then 'Unhealthy (SG)'"
       " else 'Unhealthy' end status from mf where step in (24, 48, 72)")
def mirror_cards(spark, sf_dir):
    return outlook.mirror_cards(mirrored(spark, sf_dir))


@query(f"with {OBS}, l as (select station_id, max_by(pm2_5, ts) p from obs where ts < timestamp '2024-01-24' group by 1)"
       " select station_id, cast(unnest(range(1, 73)) as int) step, p predicted from l")
def naive_forecast(spark, sf_dir):
    baseline, _ = fx.split_recent(fx.observations(spark, sf_dir))
    return outlook.naive_forecast(baseline, 72)


@query(f"with {MIRROR_SQL} select station_id, 'history' kind, ts, {pm_aqi_sql('pm2_5')} aqi, false after_gap from n where r <= 168"
       " union all select station_id, 'now', data_time, current_aqi, false from cur union all select station_id, 'forecast', ts, aqi, false from mf")
def trend_7d(spark, sf_dir):
    return outlook.trend_7d(fx.with_aqi(spark, sf_dir), fx.NOW)


@query(f"with {MIRROR_SQL}, g as (select station_id, min_by(aqi, step) f, max_by(aqi, step) l, min(aqi) mn, max(aqi) mx, stddev_pop(aqi) s from mf group by 1),"
       " p as (select station_id, cast(min(step) - 1 as int) k from mf join g using (station_id) where aqi = mx group by 1)"
       " select station_id, f first_aqi, l last_aqi, mn min_aqi, mx max_aqi, k peak_index, case when k > 48 then 'in 3 days' when k > 24 then 'in 2 days'"
       " when k > 12 then 'tomorrow' else 'in the next few hours' end peak_time, case when l > f + 10 then 'worsening' when l < f - 10 then 'improving'"
       f" else 'stable' end trend, case when s > 15 then 'daily cycle' else 'flat' end pattern, {q6('s')} spread from g join p using (station_id)")
def forecast_summary(spark, sf_dir):
    return rounded(outlook.forecast_summary(mirrored(spark, sf_dir)), "spread")


@query(f"with {MIRROR_SQL}, g as (select station_id, current_aqi, avg(aqi) m from mf group by 1, 2), d as (select *, abs(m - current_aqi) / (current_aqi + 1e-6) * 100 p from g)"
       f" select station_id, current_aqi, {q6('m')} mean_forecast, {q6('p')} difference_pct, p > 50 and current_aqi > 50 flagged from d")
def forecast_discrepancy(spark, sf_dir):
    return rounded(outlook.forecast_discrepancy(mirrored(spark, sf_dir)), "mean_forecast", "difference_pct")


# ---- scores ---------------------------------------------------------------

@query(f"with {OBS} select a.station_id, a.ts, a.pm2_5, case when b.ts is not null then b.pm2_5 else a.pm2_5 end actual_t72"
       " from obs a left join obs b on b.station_id = a.station_id and b.ts = a.ts + interval '72 hours'")
def actual_t72(spark, sf_dir):
    return evaluate.actual_ahead(fx.observations(spark, sf_dir).select("station_id", "ts", "pm2_5"))


def simple_predictions(spark, sf_dir):
    """Persistence and same-hour-yesterday predictions of every row."""
    obs = fx.observations(spark, sf_dir).select("station_id", "ts", "pm2_5")
    lagged = features.lag_features(obs)
    both = F.array(
        F.struct(F.lit("persistence").alias("model"), F.col("pm2_5_lag1").alias("predicted")),
        F.struct(F.lit("daily").alias("model"), F.col("pm2_5_lag24").alias("predicted")),
    )
    return lagged.select("station_id", F.col("pm2_5").alias("actual"), F.inline(both))


METRICS_SQL = (
    f"{OBS}, f as (select station_id, pm2_5, lag(pm2_5, 1) {W} l1, lag(pm2_5, 24) {W} l24 from obs), p as (select station_id, 'persistence' model, pm2_5 a, l1 b from f"
    " union all select station_id, 'daily', pm2_5, l24 from f), g as (select station_id, model, count(*) n, avg(abs(a - b)) mae, sqrt(avg((a - b) * (a - b))) rmse,"
    " 1 - avg((a - b) * (a - b)) / nullif(var_pop(a), 0) r2 from p where a is not null and b is not null group by 1, 2)"
)
_SCORES = ", ".join(f"{q6(c)} {c}" for c in ("mae", "rmse", "r2"))


def scored(spark, sf_dir):
    return evaluate.regression_metrics(simple_predictions(spark, sf_dir), ["station_id", "model"])


@query(f"with {METRICS_SQL} select station_id, model, n, {_SCORES} from g")
def regression_metrics(spark, sf_dir):
    return rounded(scored(spark, sf_dir), "mae", "rmse", "r2")


@query(f"with {METRICS_SQL}, w as (select *, row_number() over (partition by station_id order by rmse, model desc) k from g) select station_id, model, n, {_SCORES} from w where k = 1")
def pick_winner(spark, sf_dir):
    out = evaluate.pick_winner(scored(spark, sf_dir), ["persistence", "daily"], ["station_id"])
    return rounded(out, "mae", "rmse", "r2")


@query(f"with {METRICS_SQL}, c as (select *, greatest(0, least(100, r2 * 100)) * case when rmse > 50 then 0.8 when rmse > 30 then 0.9 else 1 end"
       " * case when mae > 40 then 0.85 when mae > 25 then 0.95 else 1 end s from g)"
       f" select station_id, model, n, {_SCORES}, (round(s, 1) + 0.0) confidence, case when s >= 85 then 'Very High' when s >= 70 then 'High'"
       " when s >= 55 then 'Moderate' when s >= 40 then 'Low' else 'Very Low' end \"level\" from c")
def confidence(spark, sf_dir):
    return rounded(evaluate.with_confidence(scored(spark, sf_dir)), "mae", "rmse", "r2")


@query(f"with {METRICS_SQL}, c as (select *, greatest(0, 100 - rmse / 3.5) p from g), d as (select *, (round(case when p > 75 then p + (100 - p) * 0.5 else p end, 1) + 0.0) a from c)"
       " select station_id, model, a accuracy, case when a >= 90 then 'Very High' when a >= 80 then 'High' else 'Moderate' end accuracy_level from d")
def display_accuracy(spark, sf_dir):
    out = evaluate.with_display_accuracy(scored(spark, sf_dir))
    return out.select("station_id", "model", "accuracy", "accuracy_level")
