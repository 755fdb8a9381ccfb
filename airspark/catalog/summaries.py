"""Quality, exploratory and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airspark import fixtures as fx
from airspark.catalog.registry import q6, query, rounded
from airspark.catalog.sql import NOW_SQL, OBS, RECENT_SQL, TIMED, WITH_AQI, aqi_sql
from airspark.functions.aqi import aqi
from airspark.functions.numbers import coerce
from airspark.functions.timefn import instant
from airspark.operators import drift, eda, features, quality
from airspark.operators.changerate import change_rate_asof
from airspark.operators.series import last_rows
from airspark.schema import CONSTITUENTS, FEATURE_TABLE, POLLUTANTS

P = POLLUTANTS
OUTLIER_COLUMNS = ["pm2_5", "pm10", "o3", "no2"]


def union_all(parts) -> str:
    return " union all ".join(parts)


def long_sql(columns, source="obs", extra="") -> str:
    return union_all(f"select station_id{extra}, '{c}' feature, {c}::double v from {source} where {c} is not null" for c in columns)


# ---- patterns -------------------------------------------------------------

def _pattern_sql(key: str) -> str:
    return f"with {TIMED} select station_id, {key}, {q6('avg(pm2_5)')} pm2_5, {q6('avg(pm10)')} pm10, {q6('avg(o3)')} o3 from timed group by 1, 2"


def _pattern(key: str):
    def run(spark, sf_dir):
        return rounded(eda.mean_by(fx.with_time(spark, sf_dir), key), *eda.PATTERN_COLUMNS)

    return run


for _key, _name in (("hour", "hourly_pattern"), ("day", "daily_pattern"), ("month", "monthly_pattern")):
    query(_pattern_sql(_key), _name)(_pattern(_key))


@query(f"with {OBS} select station_id, cast(isodow(ts) - 1 as int) day_of_week, dayname(ts) day_name, {q6('avg(pm2_5)')} pm2_5,"
       f" {q6('avg(pm10)')} pm10, {q6('avg(o3)')} o3 from obs group by 1, 2, 3")
def weekly_pattern(spark, sf_dir):
    return rounded(eda.weekly_pattern(fx.observations(spark, sf_dir)), *eda.PATTERN_COLUMNS)


@query(f"with {TIMED}, h as (" + union_all(f"select station_id, '{c}' feature, hour, avg({c}) m from timed where {c} is not null group by 1, 3" for c in P)
       + "), r as (select *, row_number() over (partition by station_id, feature order by m desc, hour) a,"
       " row_number() over (partition by station_id, feature order by m, hour) b from h),"
       " g as (select station_id, feature, max(hour) filter (a = 1) p, max(hour) filter (b = 1) l from r group by 1, 2)"
       " select station_id, feature, p peak_hour, l low_hour, strftime(make_timestamp(2000, 1, 1, p, 0, 0), '%I %p') peak_label,"
       " strftime(make_timestamp(2000, 1, 1, l, 0, 0), '%I %p') low_label from g")
def hour_extremes(spark, sf_dir):
    return eda.hour_extremes(fx.with_time(spark, sf_dir))


@query(f"with {TIMED}, h as (" + union_all(f"select station_id, '{c}' feature, month, avg({c}) m from timed where {c} is not null group by 1, 3" for c in P)
       + "), r as (select *, row_number() over (partition by station_id, feature order by m desc, month) a from h)"
       " select station_id, feature, month peak_month, monthname(make_date(2000, month, 1)) month_name from r where a = 1")
def peak_month(spark, sf_dir):
    return eda.peak_month(fx.with_time(spark, sf_dir))


# ---- spread ---------------------------------------------------------------

@query(f"with {WITH_AQI}, l as ({long_sql([*P, 'aqi'], 'a')}) select station_id, feature, count(*) count, {q6('avg(v)')} mean, {q6('stddev_samp(v)')} std,"
       f" {q6('min(v)')} min, {q6('quantile_cont(v, 0.25)')} q25, {q6('quantile_cont(v, 0.5)')} q50, {q6('quantile_cont(v, 0.75)')} q75,"
       f" {q6('max(v)')} max from l group by 1, 2")
def describe(spark, sf_dir):
    out = eda.describe(fx.with_aqi(spark, sf_dir))
    return rounded(out, "mean", "std", "min", "q25", "q50", "q75", "max")


def _fence_sql(columns) -> str:
    return (
        f"with {OBS}, l as ({long_sql(columns)}), q as (select station_id, feature, quantile_cont(v, 0.25) q25,"
        " quantile_cont(v, 0.5) q50, quantile_cont(v, 0.75) q75 from l group by 1, 2),"
        " f as (select *, q25 - 1.5 * (q75 - q25) lower, q75 + 1.5 * (q75 - q25) upper from q)"
    )


@query(_fence_sql(OUTLIER_COLUMNS) + ", n as (select station_id, count(*) c from obs group by 1)"
       f" select l.station_id, feature, {q6('lower')} lower, {q6('upper')} upper, cast(sum(case when v < lower or v > upper then 1 else 0 end) as bigint)"
       f" outliers, {q6('sum(case when v < lower or v > upper then 1 else 0 end) * 100.0::double / max(c)')} outlier_pct"
       " from l join f using (station_id, feature) join n on n.station_id = l.station_id group by 1, 2, lower, upper")
def iqr_outliers(spark, sf_dir):
    out = eda.iqr_outliers(fx.observations(spark, sf_dir), OUTLIER_COLUMNS)
    return rounded(out, "lower", "upper", "outlier_pct")


@query(_fence_sql(P) + f" select station_id, feature, {q6('upper')} upper, cast(sum(case when v > upper then 1 else 0 end) as bigint) extreme_events"
       " from l join f using (station_id, feature) group by 1, 2, upper")
def iqr_upper(spark, sf_dir):
    return rounded(eda.iqr_upper(fx.observations(spark, sf_dir), P), "upper")


@query(_fence_sql(P) + f" select station_id, feature, {q6('q25')} q25, {q6('q50')} q50, {q6('q75')} q75,"
       f" {q6('min(v) filter (v between lower and upper)')} whisker_low, {q6('max(v) filter (v between lower and upper)')} whisker_high"
       " from l join f using (station_id, feature) group by station_id, feature, q25, q50, q75")
def box_summary(spark, sf_dir):
    out = eda.box_summary(fx.observations(spark, sf_dir), P)
    return rounded(out, "q25", "q50", "q75", "whisker_low", "whisker_high")


def _bin_sql(bins: int) -> str:
    return f"least(cast(coalesce(floor((v - lo) / nullif((hi - lo) / {bins}.0::double, 0)), 0) as int), {bins - 1})"


@query(f"with {OBS}, l as ({long_sql(P)}), e as (select station_id, feature, min(v) lo, max(v) hi from l group by 1, 2),"
       f" b as (select station_id, feature, lo, hi, {_bin_sql(50)} bin from l join e using (station_id, feature))"
       f" select station_id, feature, bin, {q6('lo + bin * ((hi - lo) / 50.0::double)')} bin_from, count(*) count from b group by 1, 2, 3, lo, hi")
def histogram(spark, sf_dir):
    return rounded(eda.histogram(fx.observations(spark, sf_dir), P), "bin_from")


_POPULATION = f", case when ts < {RECENT_SQL} then 'baseline' else 'current' end population"


@query(f"with {OBS}, l as ({long_sql(P, 'obs', _POPULATION)}), e as (select station_id, feature, min(v) lo, max(v) hi from l group by 1, 2),"
       f" b as (select station_id, population, feature, {_bin_sql(30)} bin, count(*) count from l join e using (station_id, feature) group by 1, 2, 3, 4)"
       f" select *, {q6('count::double / sum(count) over (partition by station_id, population, feature)')} probability from b")
def histogram_overlay(spark, sf_dir):
    baseline, current = fx.split_recent(fx.observations(spark, sf_dir))
    return rounded(eda.histogram_overlay(baseline, current, P), "probability")


# ---- relations ------------------------------------------------------------

RATED = (
    f"{WITH_AQI}, p as (select *, last(aqi) over (partition by station_id order by ts range between interval '2 hours' preceding"
    " and interval '1 microsecond' preceding) pa from a), rated as (select *, case when aqi = 0 or pa is null or pa <= 0 then 0.0::double"
    " else (aqi - pa)::double / pa end aqi_change_rate from p)"
)
CORR_COLUMNS = [*P, "hour", "day", "month", "aqi_change_rate"]


def _r_sql(y: str, x: str) -> str:
    return q6(f"regr_sxy({y}, {x}) / nullif(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0)")


@query(f"with {RATED} " + union_all(
    f"select station_id, '{a}' a, '{b}' b, {_r_sql(b + '::double', a + '::double') if a <= b else _r_sql(a + '::double', b + '::double')} r from rated group by 1"
    for a in CORR_COLUMNS for b in CORR_COLUMNS))
def correlation_matrix(spark, sf_dir):
    rated = change_rate_asof(fx.with_aqi(spark, sf_dir))
    return rounded(eda.correlation_matrix(rated, CORR_COLUMNS), "r")


@query(f"with {RATED}, c as (" + union_all(f"select station_id, '{c}' feature, {_r_sql('pm2_5', c + '::double')} r from rated group by 1" for c in CORR_COLUMNS[1:])
       + ") select station_id, feature, r, cast(row_number() over (partition by station_id order by r desc nulls last, feature) as int) rank,"
       " (row_number() over (partition by station_id order by abs(r) desc nulls last, feature) = 1 and r is not null) strongest from c")
def corr_with_target(spark, sf_dir):
    rated = change_rate_asof(fx.with_aqi(spark, sf_dir))
    return rounded(eda.corr_ranked(rated, "pm2_5", CORR_COLUMNS[1:]), "r")


def _words_sql(v: str, arms: str) -> str:
    return f"case when {v} is null then null {arms} end"


@query(f"with {OBS}, l as ({long_sql(P)}), k as (select station_id, feature, case when count(v) >= 3 then skewness(v) end s from l group by 1, 2)"
       f" select station_id, feature, {q6('s')} skew, " + _words_sql("s", "when s > 1 then 'Highly Skewed (Right)' when s < -1 then 'Highly Skewed (Left)' else 'Normal / Balanced'")
       + " shape from k")
def distribution_shape(spark, sf_dir):
    return rounded(eda.distribution_shape(fx.observations(spark, sf_dir)), "skew")


@query(f"with {OBS}, l as ({long_sql(P, 'obs', ', ts')}), n as (select *, row_number() over (partition by station_id, feature order by ts) - 1 x from l),"
       " k as (select station_id, feature, regr_slope(v, x) * 24 s from n group by 1, 2)"
       f" select station_id, feature, {q6('s')} per_day, " + _words_sql(
           "s", "when s > 1 then 'worsening rapidly' when s > 0.1 then 'increasing slightly' when s < -1 then 'improving rapidly'"
           " when s < -0.1 then 'decreasing slightly' else 'stable'") + " trend from k")
def trend_slope(spark, sf_dir):
    return rounded(eda.trend_slope(fx.observations(spark, sf_dir)), "per_day")


REPORT_COLUMNS = [*P, "hour", "day", "month"]


@query(f"with {TIMED}, s as (select station_id, avg(pm2_5) mean, median(pm2_5) median, stddev_samp(pm2_5) std, min(pm2_5) min, max(pm2_5) max from timed group by 1), "
       + "h as (select station_id, hour, row_number() over (partition by station_id order by avg(pm2_5) desc, hour) r from timed group by 1, 2), "
       + "m as (select station_id, month, row_number() over (partition by station_id order by avg(pm2_5) desc, month) r from timed group by 1, 2), "
       + "c as (" + union_all(f"select station_id, '{c}' f, regr_sxy(pm2_5, {c}) / nullif(sqrt(regr_sxx(pm2_5, {c}) * regr_syy(pm2_5, {c})), 0) r from timed group by 1" for c in P[1:])
       + "), b as (select *, row_number() over (partition by station_id order by abs(r) desc nulls last, f) k from c) "
       + union_all([f"select station_id, 'statistics' section, '{x}' metric, {q6(x)} \"value\", cast(null as varchar) \"label\" from s" for x in ("mean", "median", "std", "min", "max")]
                   + ["select station_id, 'temporal', 'peak_hour', hour::double, null from h where r = 1",
                      "select station_id, 'temporal', 'peak_month', month::double, strftime(make_date(2000, month, 1), '%b') from m where r = 1",
                      f"select station_id, 'correlation', 'strongest', {q6('r')}, f from b where k = 1 and r is not null",
                      "select station_id, 'quality', 'missing_pct', " + q6(f"({' + '.join(f'count(*) - count({c})' for c in REPORT_COLUMNS)}) * 100.0::double / (count(*) * {len(REPORT_COLUMNS)})") + ", null from timed group by 1"]))
def eda_report(spark, sf_dir):
    return rounded(eda.eda_report(fx.with_time(spark, sf_dir), REPORT_COLUMNS), "value")


# ---- quality --------------------------------------------------------------

@query(f"with {OBS}, n as (select station_id, count(*) c from obs group by 1), m as ("
       + union_all(f"select station_id, '{c}' column_name, count(*) - count({c}) missing from obs group by 1" for c in ['ts', *P])
       + f") select station_id, column_name, missing, {q6('missing * 100.0::double / c')} missing_pct from m join n using (station_id) where missing > 0")
def missing_report(spark, sf_dir):
    return rounded(quality.missing_report(fx.observations(spark, sf_dir)), "missing_pct")


@query(f"with {OBS} select station_id, count(*) \"rows\", cast(8 as int) \"columns\", min(ts) first_ts, max(ts) last_ts,"
       " cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) as bigint) span_days from obs group by 1")
def table_stats(spark, sf_dir):
    return quality.table_stats(fx.observations(spark, sf_dir))


@query(f"with {OBS} select station_id, bool_and(coalesce(pm2_5 between 0 and 200, false)) in_range,"
       " count(*) filter (not coalesce(pm2_5 between 0 and 200, false)) violations, count(*) \"rows\" from obs group by 1")
def range_check(spark, sf_dir):
    return quality.range_check(fx.observations(spark, sf_dir))


_RULES = {f"{p}_not_negative": f"{p} >= 0" for p in P} | {
    "pm2_5_not_above_pm10": "pm2_5 <= pm10", "pm2_5_below_1000": "pm2_5 < 1000", "pm10_below_1000": "pm10 < 1000",
    "hour_valid": "hour between 0 and 23", "day_valid": "day between 1 and 31", "month_valid": "month between 1 and 12"}


@query(f"with {TIMED} " + union_all(f"select station_id, '{n}' rule, count(*) filter (not ({r})) violations from timed group by 1" for n, r in _RULES.items()))
def quality_rules(spark, sf_dir):
    return quality.rule_violations(fx.with_time(spark, sf_dir))


@query(f"with {OBS}, o as (select * from obs where ts <= {NOW_SQL}), g as (select station_id,"
       " (epoch_us(ts) - epoch_us(lag(ts) over (partition by station_id order by ts))) / 3600000000.0 gap from o),"
       " s as (select station_id, count(*) n, avg(gap) a, min(gap) b, max(gap) c from g group by 1)"
       f" select station_id, n \"rows\", {q6('a')} mean_gap, {q6('b')} min_gap, {q6('c')} max_gap,"
       " coalesce(a between 0.9 and 1.1 and b >= 0.8 and c <= 1.5, false) hourly from s")
def interval_check(spark, sf_dir):
    out = quality.interval_check(fx.actual(fx.observations(spark, sf_dir)))
    return rounded(out, "mean_gap", "min_gap", "max_gap")


_AGE = f"(epoch_us({NOW_SQL}) - epoch_us(ing)) / 3600000000.0"


@query(f"with {OBS}, o as (select station_id, max(ts) m from obs where ts <= {NOW_SQL} group by 1), i as (select *, m + interval '5 minutes' ing from o),"
       f" g as (select *, {_AGE} h from i) select station_id, m measured_at, ing ingested_at, {q6('h')} age_hours,"
       " case when h < 0 then 'Forecast' when h < 1 and floor(h * 60) = 0 then '< 1 min' when h < 1 then cast(floor(h * 60) as int) || ' min'"
       " when h < 24 then cast(floor(h) as int) || case when floor(h) = 1 then ' hour' else ' hours' end"
       " else cast(floor(h / 24) as int) || case when floor(h / 24) = 1 then ' day' else ' days' end end age_label,"
       " h > 2 stale, h > 12 severe from g")
def freshness(spark, sf_dir):
    obs = fx.observations(spark, sf_dir).withColumn("ingestion_timestamp", F.col("ts") + F.expr("interval 5 minutes"))
    return rounded(quality.freshness(obs, fx.NOW), "age_hours")


@query(f"with {OBS}, o as (select *, row_number() over (partition by station_id order by ts desc) r from obs where ts <= {NOW_SQL}) "
       + union_all(f"select station_id, '{label}' constituent, {key} \"value\", '{unit}' unit from o where r = 1 and {key} is not null" for key, label, unit in CONSTITUENTS))
def constituents(spark, sf_dir):
    latest = last_rows(fx.actual(fx.observations(spark, sf_dir)), 1)
    return quality.constituents(latest, CONSTITUENTS)


@query("select event_id, try_cast(regexp_replace(props, '[^0-9]', '', 'g') as double) k, try_cast(event_type as double) bad,"
       " try_cast(cast(value as varchar) as double) v from events")
def coerce_numeric(spark, sf_dir):
    digits = F.regexp_replace("props", "[^0-9]", "")
    return fx.events(spark, sf_dir).select(
        "event_id", coerce(digits).alias("k"), coerce(F.col("event_type")).alias("bad"), coerce(F.col("value").cast("string")).alias("v")
    )


@query("select event_id, ts naive, ts - interval '5 hours' offset_ts from events")
def utc_normalise(spark, sf_dir):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = fx.events(spark, sf_dir).select("event_id", text.alias("a"), F.concat(text, F.lit("+05:00")).alias("b"))
    out = quality.utc_normalise(quality.utc_normalise(raw, "a", "naive"), "b", "offset_ts")
    return out.select("event_id", "naive", "offset_ts")


@query(f"with {TIMED}, u as (select station_id, ts, pm2_5, pm10, o3, no2, so2, null::double co, hour, day, month from timed where ts < timestamp '2024-01-16'"
       " union all select station_id, ts, pm2_5, pm10, o3, no2, so2, co, null, null, null from timed where ts >= timestamp '2024-01-16')"
       f" select *, {aqi_sql()} aqi, null::double aqi_change_rate, null::timestamp ingestion_timestamp from u")
def align_schema(spark, sf_dir):
    timed = fx.with_time(spark, sf_dir)
    cut = instant(timed, "2024-01-16 00:00:00")
    left = timed.where(F.col("ts") < cut).drop("co")
    right = timed.where(F.col("ts") >= cut).drop("hour", "day", "month").withColumn("junk", F.lit("x")).withColumnRenamed("pm10", "PM10")
    both = quality.align_schema(left, FEATURE_TABLE).unionByName(quality.align_schema(right, FEATURE_TABLE))
    return quality.align_schema(both.withColumn("aqi", aqi().cast("bigint")), FEATURE_TABLE)


# ---- drift ----------------------------------------------------------------

def _drift_sql(columns, thresholds="0.2::double") -> str:
    long = union_all(
        f"select station_id, '{c}' feature, ts < {RECENT_SQL} base, {c}::double v from a where {c} is not null" for c in columns)
    return (
        f"with {WITH_AQI}, l as ({long}), b as (select station_id, feature, avg(v) m, stddev_samp(v) s, median(v) d, quantile_cont(v, 0.05) p05,"
        " quantile_cont(v, 0.95) p95 from l where base group by 1, 2), c as (select station_id, feature, avg(v) m, stddev_samp(v) s, median(v) d"
        " from l where not base group by 1, 2), o as (select station_id, feature, count(*) filter (v < p05 or v > p95)::double / count(*) share"
        " from l join b using (station_id, feature) where not base group by 1, 2),"
        " x as (select station_id, feature, b.m bm, b.s bs, b.d bd, b.p05, b.p95, c.m cm, c.s cs, c.d cd, o.share,"
        f" {thresholds} threshold, abs(c.m - b.m) / (b.s + 1e-6) d1, abs(c.m - b.m) / (abs(b.m) + 1e-6) d2,"
        " abs(c.d - b.d) / (abs(b.d) + 1e-6) d3, abs(c.s - b.s) / (b.s + 1e-6) d4 from b join c using (station_id, feature) join o using (station_id, feature)),"
        " v as (select *, coalesce(d1 > threshold, false) or coalesce(d2 > threshold, false) or coalesce(d3 > threshold, false)"
        " or coalesce(d4 > threshold, false) or share > 0.3 drift from x) "
    )


def _flagged(df):
    return drift.flagged(df, fx.is_baseline(df))


DRIFT_NUMBERS = ["base_mean", "base_std", "base_median", "base_p05", "base_p95", "current_mean", "current_std", "current_median",
                 "outside_share", "mean_diff", "mean_diff_absolute", "median_diff", "std_diff"]


@query(_drift_sql(["pm2_5"]) + "select station_id, feature, threshold, drift, " + ", ".join(
    f"{q6(e)} {n}" for n, e in zip(DRIFT_NUMBERS, ["bm", "bs", "bd", "p05", "p95", "cm", "cs", "cd", "share", "d1", "d2", "d3", "d4"])) + " from v")
def drift_metrics(spark, sf_dir):
    return rounded(drift.metrics(_flagged(fx.observations(spark, sf_dir)), ["pm2_5"]), *DRIFT_NUMBERS)


@query(_drift_sql(drift.MONITORED, "case when feature = 'aqi' then 0.15::double else 0.2::double end")
       + f"select station_id, feature, threshold, drift, {q6('d1')} mean_diff, {q6('d3')} median_diff, {q6('d4')} std_diff, {q6('share')} outside_share from v")
def drift_status(spark, sf_dir):
    return rounded(drift.status(_flagged(fx.with_aqi(spark, sf_dir))), "mean_diff", "median_diff", "std_diff", "outside_share")


@query(_drift_sql(P) + ", w as (select *, case when bm <> 0 then (cm - bm) / bm * 100 when cm > 0 then 100.0 else 0.0 end pct from v where drift)"
       f" select station_id, feature, {q6('abs(pct)')} shift_pct, case when pct > 0 then 'Higher' else 'Lower' end direction,"
       f" case when pct > 0 then 'Spike detected' else 'Drop detected' end description, {q6('bm')} base_mean, {q6('cm')} current_mean,"
       f" {q6('share * 100')} outside_pct, share * 100 > 20 alert from w")
def drift_causes(spark, sf_dir):
    return rounded(drift.causes(_flagged(fx.observations(spark, sf_dir)), P), "shift_pct", "base_mean", "current_mean", "outside_pct")


@query(f"with {OBS}, l as (" + union_all(f"select station_id, '{c}' feature, ts < {RECENT_SQL} base, {c} v from obs where {c} is not null" for c in P)
       + "), g as (select station_id, feature, v, count(*) filter (base) nb, count(*) filter (not base) nc from l group by 1, 2, 3),"
       " k as (select *, sum(nb) over w cb, sum(nc) over w cc, sum(nb) over t tb, sum(nc) over t tc from g window w as"
       " (partition by station_id, feature order by v), t as (partition by station_id, feature))"
       f" select station_id, feature, {q6('max(abs(cb / nullif(tb, 0)::double - cc / nullif(tc, 0)::double))')} ks, cast(max(tb) as bigint) n_base, cast(max(tc) as bigint) n_current from k group by 1, 2")
def drift_ks(spark, sf_dir):
    return rounded(drift.ks(_flagged(fx.observations(spark, sf_dir)), P), "ks")
