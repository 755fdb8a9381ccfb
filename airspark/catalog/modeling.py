"""Model, recursive-forecast, explanation and stream queries."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from airspark import fixtures as fx
from airspark.catalog.learning import INPUTS, LABELLED_SQL, W, rated
from airspark.catalog.registry import q6, query, rounded
from airspark.catalog.sql import NOW_SQL, OBS, RECENT_SQL, WITH_AQI
from airspark.catalog.summaries import union_all
from airspark.catalog.values import _RATE as RATE_SQL
from airspark.catalog.tables import BY, COLUMNS, daily_payloads
from airspark.operators import univariate
from airspark.operators.features import full_features
from airspark.operators.quality import SEVERE_HOURS, STALE_HOURS
from airspark.operators.series import last_rows
from airspark.plans import dataset, evaluate, explain, forecast, models, training
from airspark.plans.serving import recent_state
from airspark.schema import POLLUTANTS
from airspark.session import scratch_path, written
from airspark.sources.payload import payload_json
from airspark.sources.store import FeatureStore
from airspark.streaming import ingest

P = POLLUTANTS


# ---- fitting --------------------------------------------------------------

def labelled_table(spark, sf_dir):
    return written(dataset.labelled(rated(spark, sf_dir)), "labelled")


def split(rows):
    scaled, names, scaler = dataset.scaled_set(rows)
    marked = dataset.chrono_split(scaled)
    return marked.where("is_train"), marked.where(~F.col("is_train")), names, scaler


def _fit(rows, name, estimator):
    train, test, names, scaler = split(rows)
    return models.fit(name, estimator, train, names, scaler), test


def _tuned(rows, name):
    train, test, names, scaler = split(rows)
    return models.tuned(name, train, names, scaler)[0], test


def _scores(fitted, test):
    guessed = fitted.predict_scaled(test).select(
        F.lit(fitted.name).alias("model"), F.col("target").alias("actual"), F.col("prediction").alias("predicted")
    )
    return evaluate.regression_metrics(guessed, ["model"])


@query()
def fit_gbt(spark, sf_dir):
    return _scores(*_tuned(labelled_table(spark, sf_dir), "gbt"))


@query()
def fit_rf(spark, sf_dir):
    return _scores(*_tuned(labelled_table(spark, sf_dir), "forest"))


@query()
def fit_robust_linear(spark, sf_dir):
    return _scores(*_tuned(labelled_table(spark, sf_dir), "robust_linear"))


@query()
def fit_huber(spark, sf_dir):
    return _scores(*_fit(labelled_table(spark, sf_dir), "huber", models.robust_linear()))


@query()
def random_search(spark, sf_dir):
    train, _, names, scaler = split(labelled_table(spark, sf_dir))
    _, report = models.tuned("robust_linear", train, names, scaler)
    return spark.createDataFrame(report, "settings string, rmse double")


@query()
def random_search_huber(spark, sf_dir):
    train, _, names, scaler = split(labelled_table(spark, sf_dir))
    _, report = models.random_search("huber", models.robust_linear(), models.HUBER_GRID, train, names, scaler, n_iter=15)
    return spark.createDataFrame(report, "settings string, rmse double")


_DF = f"with {OBS}, l as (select station_id, pm2_5, lag(pm2_5) {W} x, pm2_5 - lag(pm2_5) {W} y from obs)"


@query(f"{_DF}, s as (select station_id, cast(regr_count(y, x) as bigint) n, regr_slope(y, x) slope, regr_sxx(y, x) sxx, regr_syy(y, x) syy, regr_sxy(y, x) sxy from l group by 1),"
       " t as (select *, slope / sqrt((syy - slope * sxy) / (n - 2) / sxx) t from s)"
       f" select station_id, n, {q6('slope')} slope, {q6('t')} t_value, coalesce(t < -2.86, false) stationary, cast(case when t < -2.86 then 0 else 1 end as int) differences from t")
def stationarity(spark, sf_dir):
    return rounded(univariate.stationarity(fx.observations(spark, sf_dir)), "slope", "t_value")


_LAG2 = f"with {OBS}, l as (select station_id, pm2_5 - lag(pm2_5) {W} y, lag(pm2_5) {W} v, lag(pm2_5) {W} - lag(pm2_5, 2) {W} u from obs), g as (select * from l where u is not null)"


@query(f"{_LAG2}, s as (select station_id, count(*) n, regr_sxx(y, v) a, regr_sxx(y, u) b, regr_sxy(v, u) c, regr_sxy(y, v) p, regr_sxy(y, u) q, regr_syy(y, v) yy from g group by 1),"
       " f as (select *, a * b - c * c det, (p * b - q * c) / (a * b - c * c) slope, (q * a - p * c) / (a * b - c * c) step from s),"
       " t as (select *, slope / sqrt((yy - slope * p - step * q) / (n - 3) * b / det) t from f)"
       f" select station_id, n, 1::int lags, {q6('slope')} slope, {q6('t')} t_value, t < -2.86 stationary, cast(case when t < -2.86 then 0 else 1 end as int) differences from t")
def stationarity_one_lag(spark, sf_dir):
    """The augmented test with one earlier step."""
    return rounded(univariate.augmented_stationarity(fx.observations(spark, sf_dir), most_lags=1, lags=1), "slope", "t_value")


@query()
def stationarity_by_aic(spark, sf_dir):
    return univariate.augmented_stationarity(fx.observations(spark, sf_dir))


@query()
def fit_seasonal_ar(spark, sf_dir):
    return univariate.fit_seasonal_ar(fx.observations(spark, sf_dir))


@query()
def forecast_seasonal_ar(spark, sf_dir):
    baseline, _ = fx.split_recent(fx.observations(spark, sf_dir))
    return univariate.seasonal_ar_forecast(baseline, univariate.fit_seasonal_ar(baseline), 72)


@query()
def fit_harmonic(spark, sf_dir):
    return univariate.fit_harmonic(fx.observations(spark, sf_dir))


@query()
def forecast_harmonic(spark, sf_dir):
    baseline, current = fx.split_recent(fx.observations(spark, sf_dir))
    guessed = univariate.harmonic_predict(current.select("station_id", "ts", "pm2_5"), univariate.fit_harmonic(baseline))
    return evaluate.regression_metrics(guessed.withColumnRenamed("pm2_5", "actual"), ["station_id"])


@query()
def training_comparison(spark, sf_dir):
    """Scores of all models with plain settings, all of them eligible, and which one was stored."""
    root = scratch_path(spark, "models")
    chosen = {"gbt": models.gbt(maxIter=10, maxDepth=3), "forest": models.forest(numTrees=10, maxDepth=5), "robust_linear": models.robust_linear()}
    table, _ = training.train_and_compare(rated(spark, sf_dir), root, chosen, all_eligible=True)
    stored = models.registry(spark, root).select(F.col("model"), F.lit(True).alias("stored"))
    return table.join(stored, "model", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


# ---- use of a model -------------------------------------------------------

def linear_model(rows):
    return _fit(rows, "robust_linear", models.robust_linear())[0]


@query()
def register_model(spark, sf_dir):
    fitted, test = _fit(labelled_table(spark, sf_dir), "robust_linear", models.robust_linear())
    metrics = _scores(fitted, test).first().asDict()
    root = scratch_path(spark, "models")
    models.register(spark, root, fitted, metrics)
    models.register(spark, root, fitted, metrics)
    loaded = models.load(spark, root, LinearRegressionModel)
    return models.registry(spark, root).withColumn("features", F.lit(len(loaded.names)))


@query()
def score_batch(spark, sf_dir):
    known = labelled_table(spark, sf_dir)
    # Every stored row is scored, whether or not its next value is known.
    return linear_model(known).predict(full_features(rated(spark, sf_dir)))


@query()
def recursive_forecast(spark, sf_dir):
    model = linear_model(labelled_table(spark, sf_dir))
    state = recent_state(rated(spark, sf_dir), fx.NOW)
    return forecast.forecast_rows(forecast.or_last_value(forecast.recursive_forecast(state, model)))


@query()
def recursive_forecast_trees(spark, sf_dir):
    rows = labelled_table(spark, sf_dir)
    fitted, _ = _fit(rows, "gbt", models.gbt(maxIter=10, maxDepth=3))
    state = recent_state(rated(spark, sf_dir), fx.NOW)
    return forecast.forecast_rows(forecast.or_last_value(forecast.recursive_forecast(state, fitted)))


@query()
def backtest_t72(spark, sf_dir):
    rows = labelled_table(spark, sf_dir)
    return forecast.backtest_t72(dataset.chrono_split(rows), ~F.col("is_train"), linear_model(rows))


@query()
def live_metrics(spark, sf_dir):
    rows = labelled_table(spark, sf_dir)
    return forecast.live_metrics(fx.actual(rated(spark, sf_dir)), linear_model(rows))


# ---- explanation ----------------------------------------------------------

# A plain linear model with fixed weights, so that SQL can give the same numbers.
WEIGHTS = {
    "pm2_5": 0.4, "pm2_5_lag1": 0.2, "pm2_5_lag2": 0.05, "pm2_5_lag3": -0.05, "pm2_5_lag24": 0.15, "pm2_5_lag48": 0.05,
    "recent_hour_avg": 0.1, "pm2_5_rolling_mean_24h": 0.2, "diff_24h": -0.1, "o3": 0.01, "no2": -0.02, "pm10": 0.03,
}


def _fixed_linear(spark, sf_dir):
    rows = labelled_table(spark, sf_dir)
    means = dataset.Scaler.fit(rows, list(WEIGHTS)).mean
    return explain.linear_attribution(rows, WEIGHTS, means, ["station_id", "ts"])


_IMPACT_SQL = f"{LABELLED_SQL}, im as (" + union_all(
    f"select station_id, ts, '{n}' feature, {n}::double \"value\", {w}::double * ({n} - avg({n}) over ()) impact from s" for n, w in WEIGHTS.items()) + ")"


@query(f"with {_IMPACT_SQL} select station_id, ts, feature, {q6('value')} \"value\", {q6('impact')} impact from im")
def shapley_linear(spark, sf_dir):
    return rounded(_fixed_linear(spark, sf_dir), "value", "impact")


@query(f"with {_IMPACT_SQL}, g as (select feature, avg(abs(impact)) a, avg(impact) m from im group by 1)"
       f" select feature, {q6('a')} mean_abs, {q6('m')} mean_impact, cast(rank() over (order by a desc) as int) rank from g")
def importance_linear(spark, sf_dir):
    return rounded(explain.importance(_fixed_linear(spark, sf_dir)), "mean_abs", "mean_impact")


_NAMES_SQL = "case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in explain.DISPLAY_NAMES.items()) + " end"


@query(f"with {_IMPACT_SQL}, l as (select station_id, max(ts) ts from s group by 1), r as (select im.*, row_number() over (partition by station_id order by abs(impact) desc, feature) k"
       " from im join l using (station_id, ts))"
       f" select station_id, cast(k as int) place, {_NAMES_SQL} feature, {q6('value')} \"value\", {q6('impact')} impact, {q6('abs(impact)')} abs_impact,"
       " case when impact > 0 then 'Pushing Up' else 'Pulling Down' end direction from r where k <= 10")
def top_drivers(spark, sf_dir):
    rows = labelled_table(spark, sf_dir)
    means = dataset.Scaler.fit(rows, list(WEIGHTS)).mean
    newest = explain.linear_attribution(last_rows(rows, 1), WEIGHTS, means, ["station_id", "ts"])
    return rounded(explain.top_drivers(newest), "value", "impact", "abs_impact")


@query(f"with {LABELLED_SQL}, c as (" + union_all(
    f"select station_id, '{c}' feature, regr_sxy(pm2_5, {c}::double) / nullif(sqrt(regr_sxx(pm2_5, {c}::double) * regr_syy(pm2_5, {c}::double)), 0) r from s where ts >= {RECENT_SQL} group by 1"
    for c in INPUTS) + f") select station_id, feature, {q6('coalesce(r, 0) * 10')} impact from c")
def corr_impact(spark, sf_dir):
    _, recent = fx.split_recent(dataset.labelled(rated(spark, sf_dir)))
    return rounded(explain.correlation_impact(recent, INPUTS), "impact")


def _explained(spark, sf_dir):
    train, test, names, scaler = split(labelled_table(spark, sf_dir))
    return models.fit("gbt", models.gbt(maxIter=10, maxDepth=3), train, names, scaler), train, test


@query()
def shapley_local(spark, sf_dir):
    fitted, train, test = _explained(spark, sf_dir)
    return explain.tree_shapley(last_rows(test, 1), fitted, ["station_id", "ts"])


@query()
def shapley_global(spark, sf_dir):
    fitted, train, test = _explained(spark, sf_dir)
    return explain.importance(explain.tree_shapley(test, fitted, ["station_id", "ts"]))


@query()
def shapley_kernel(spark, sf_dir):
    """The same by a regression on coalitions, for the linear model."""
    train, test, names, scaler = split(labelled_table(spark, sf_dir))
    fitted = models.fit("huber", models.robust_linear(), train, names, scaler)
    return explain.kernel_shapley(last_rows(test, 1), train, fitted, ["station_id", "ts"])


@query()
def shapley_sampled(spark, sf_dir):
    """The same by sampled feature orders, which fit any model."""
    fitted, train, test = _explained(spark, sf_dir)
    return explain.shapley(last_rows(test, 1), train, fitted, ["station_id", "ts"])


@query()
def lime_local(spark, sf_dir):
    fitted, _, test = _explained(spark, sf_dir)
    return explain.lime(last_rows(test, 1), fitted, ["station_id", "ts"])


# ---- streams --------------------------------------------------------------

def _envelopes(spark, sf_dir):
    """Every day's payload of every station, and every fifth day again with pm2_5 one higher."""
    rows = fx.observations(spark, sf_dir)
    sent = F.col("d").cast("timestamp_ntz")
    first = payload_json(daily_payloads(rows), BY).withColumn("sent_at", sent + F.expr("interval 1 day"))
    fifth = rows.where(F.dayofmonth("ts") % 5 == 0).withColumn("pm2_5", F.col("pm2_5") + 1)
    again = payload_json(daily_payloads(fifth), BY).withColumn("sent_at", sent + F.expr("interval 2 days"))
    return first.select("station_id", "sent_at", "payload"), again.select("station_id", "sent_at", "payload")


_RESENT = f"{OBS.replace('obs as (', 'obs0 as (')}, obs as (select * replace (pm2_5 + case when day(ts) % 5 = 0 then 1 else 0 end as pm2_5) from obs0)"
_RESENT_AQI = _RESENT + WITH_AQI[len(OBS):]


_TIMED_AQI = WITH_AQI[len(OBS):]
_FIRST_AQI = _TIMED_AQI.replace("timed", "timed0").replace("from obs)", "from obs0)").replace(" a as (", " a0 as (")


def _rated_sql(source: str, name: str) -> str:
    """Change rates as of the two hours before, over one state of the table."""
    return (
        f", {name}_p as (select *, last(aqi) over (partition by station_id order by ts range between interval '7200000000 microseconds' preceding"
        f" and interval '1 microseconds' preceding) prev_aqi from {source}), {name} as (select *, {q6(RATE_SQL)} rate from {name}_p)"
    )


# Rows of resent days are rated over the second state, all others over the first.
_STREAMED = f"{_RESENT_AQI}{_FIRST_AQI}{_rated_sql('a0', 'r0')}{_rated_sql('a', 'r1')}, s as (select * from r0 where day % 5 <> 0 union all select * from r1 where day % 5 = 0)"


@query(f"with {_STREAMED} select station_id, ts, {COLUMNS}, hour, day, month, aqi, rate aqi_change_rate, cast(cast(ts as date) as timestamp) + case when day % 5 = 0 then interval '2 days'"
       " else interval '1 day' end ingestion_timestamp from s")
def stream_ingest(spark, sf_dir):
    folder, state, alerts = (scratch_path(spark, label) for label in ("payloads", "stream-state", "alerts"))
    store = FeatureStore(spark, scratch_path(spark, "stream-store")).init()
    # What is sent again arrives once the first files are worked off, so that no batch holds
    # both states, however many files there are. What it repeats is replaced.
    for sent in _envelopes(spark, sf_dir):
        sent.repartition(3, "station_id").write.mode("append").json(folder)  # a station's days arrive together
        stream = ingest.payload_stream(spark, folder, files_per_batch=2)
        ingest.ingest_payloads(stream, store, state, fx.NOW, alerts).awaitTermination()
    return rounded(store.read(), "aqi_change_rate")


#: Longer than any delay between the envelopes' send times and their delivery here.
_DELAY = "60 days"


def _delivered(spark, sf_dir):
    """The files of a folder to which every envelope was delivered twice, in files of different batches."""
    folder = scratch_path(spark, "payloads")
    first, again = _envelopes(spark, sf_dir)
    for part in (first, first, again, again):
        part.repartition(2, "station_id").write.mode("append").json(folder)
    return ingest.payload_stream(spark, folder, files_per_batch=2)


@query(f"with {OBS}, d as (select distinct station_id, cast(ts as date) d from obs), e as (select station_id, cast(d as timestamp) + interval '1 day' sent_at from d"
       " union all select station_id, cast(d as timestamp) + interval '2 days' from d where day(d) % 5 = 0) select station_id, sent_at, count(*) n from e group by 1, 2")
def stream_repeats(spark, sf_dir):
    """How many envelopes of a station and send time get past the removal of repeats."""
    folder = scratch_path(spark, "distinct")
    passed = ingest.distinct_envelopes(_delivered(spark, sf_dir), _DELAY).select("station_id", "sent_at")
    job = passed.writeStream.format("parquet").option("path", folder).option("checkpointLocation", scratch_path(spark, "distinct-state"))
    job.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("station_id int, sent_at timestamp_ntz").parquet(folder).groupBy("station_id", "sent_at").agg(F.count("*").alias("n"))


@query(f"with {_STREAMED}, w as (select *, cast(cast(ts as date) as timestamp) + case when day % 5 = 0 then interval '2 days' else interval '1 day' end ingested_at from s where ts <= {NOW_SQL}),"
       " m as (select station_id, max(ts) measured_at, max_by(ingested_at, ts) ingested_at from w group by 1), h as (select *, "
       f"date_diff('microsecond', ingested_at, {NOW_SQL}) / 3600e6 age from m) select station_id, measured_at, ingested_at, {q6('age')} age_hours, age > {STALE_HOURS} stale, age > {SEVERE_HOURS} severe from h")
def stream_alerts(spark, sf_dir):
    """The last age report of every station after envelopes were delivered twice."""
    alerts = scratch_path(spark, "alerts")
    store = FeatureStore(spark, scratch_path(spark, "stream-store")).init()
    ingest.ingest_payloads(_delivered(spark, sf_dir), store, scratch_path(spark, "stream-state"), fx.NOW, alerts, _DELAY).awaitTermination()
    out = ingest.latest_alerts(spark, alerts).select("station_id", "measured_at", "ingested_at", "age_hours", "stale", "severe")
    return rounded(out, "age_hours")


@query("select cast(floor(user_id / 16) as int) station_id, date_trunc('hour', ts) hour_start, " + q6("avg(value)") + " mean_value, count(*) n from events group by 1, 2")
def stream_hourly(spark, sf_dir):
    events = fx.events(spark, sf_dir)
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    keyed = source.select(F.floor(F.col("user_id") / fx.USERS_PER_STATION).cast("int").alias("station_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    folder = scratch_path(spark, "hourly")
    ingest.write_updates(ingest.hourly_means(keyed), folder, scratch_path(spark, "hourly-state")).awaitTermination()
    out = ingest.latest_updates(spark, folder).withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))
    return rounded(out, "mean_value")
