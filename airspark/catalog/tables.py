"""Payload, store, filter, top-k, merge and job queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from airspark import fixtures as fx
from airspark.catalog.registry import q6, query, rounded
from airspark.catalog.sql import NOW_SQL, OBS, TIMED, WITH_AQI, aqi_sql
from airspark.catalog.values import CHUNK_SQL
from airspark.functions.aqi import aqi
from airspark.functions.timefn import hours_between, instant
from airspark.operators import merge, quality, series
from airspark.plans import jobs
from airspark.schema import FEATURE_TABLE, POLLUTANTS
from airspark.session import scratch_path
from airspark.sources import payload, store

P = POLLUTANTS
COLUMNS = ", ".join(P)
BY = ["station_id", "d"]


# ---- payloads -------------------------------------------------------------

def daily_payloads(obs):
    """One payload per station and day."""
    return payload.to_payload(obs.withColumn("d", F.to_date("ts")), BY)


@query(f"with {OBS}, n as (select *, row_number() over (partition by station_id, cast(ts as date) order by ts desc) r from obs)"
       " select station_id, ts, pm2_5, case when day(ts) % 2 = 0 and r = 1 then null else pm10 end pm10, o3, no2, so2,"
       " case when day(ts) % 7 <> 0 then co end co from n")
def parse_payload(spark, sf_dir):
    day = F.dayofmonth("d")
    h = F.col("hourly")
    shorter = F.when(day % 2 == 0, F.slice(h["pm10"], 1, F.size(h["pm10"]) - 1)).otherwise(h["pm10"])
    longer = F.when(day % 3 == 0, F.array_append(h["sulphur_dioxide"], F.lit(1.0))).otherwise(h["sulphur_dioxide"])
    absent = F.when(day % 7 != 0, h["carbon_monoxide"])
    damaged = h.withField("pm10", shorter).withField("sulphur_dioxide", longer).withField("carbon_monoxide", absent)
    raw = daily_payloads(fx.observations(spark, sf_dir)).withColumn("hourly", damaged)
    return payload.parse_payload(payload.payload_json(raw, BY))


@query(f"with {OBS} select station_id, ts, {COLUMNS} from obs")
def parse_payload_strict(spark, sf_dir):
    raw = daily_payloads(fx.observations(spark, sf_dir))
    return payload.parse_payload_strict(payload.payload_json(raw, BY))


# At this hour some stations have no row yet, so that the fallback is used as well.
_EARLY = "timestamp '2024-01-01 01:00:00'"


@query(f"with {OBS}, n as (select *, row_number() over (partition by station_id order by ts > {_EARLY}, abs(epoch_us(ts) - epoch_us({_EARLY}))) r from obs)"
       f" select station_id, ts, {COLUMNS}, ts > {_EARLY} is_forecast from n where r = 1")
def pick_current(spark, sf_dir):
    return payload.pick_current(fx.observations(spark, sf_dir), "2024-01-01 01:40:00")


@query(f"with {OBS}, n as (select *, row_number() over (partition by station_id order by ts > {NOW_SQL}, abs(epoch_us(ts) - epoch_us({NOW_SQL}))) r from obs)"
       f" select station_id, ts, {COLUMNS}, ts > {NOW_SQL} is_forecast from n where r = 1")
def pick_current_whole(spark, sf_dir):
    """The current row of every station, from all rows."""
    return payload.pick_current(fx.observations(spark, sf_dir), "2024-01-30 12:40:00")


@query(f"with {OBS}, s as (select station_id, cast(min(ts) as date) s, cast(max(ts) as date) e from obs group by 1),"
       " c as (select station_id, e, s, unnest(range(cast(floor(date_diff('day', s, e) / 8) as bigint) + 1)) i from s)"
       " select station_id, cast(i as int) chunk_id, cast(s + cast(i * 8 as int) as date) chunk_start, cast(least(s + cast(i * 8 + 7 as int), e) as date) chunk_end from c")
def chunk_windows(spark, sf_dir):
    spans = fx.observations(spark, sf_dir).groupBy("station_id").agg(
        F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("end")
    )
    return payload.chunk_windows(spans)


# ---- store ----------------------------------------------------------------

STORED = f"""select station_id, ts, {COLUMNS}, hour, day, month, {{aqi}} aqi, null::double aqi_change_rate, null::timestamp ingestion_timestamp"""


def _new_store(spark, label: str) -> store.FeatureStore:
    return store.FeatureStore(spark, scratch_path(spark, label))


@query(f"with {WITH_AQI} select station_id, ts, pm2_5 + case when ts >= timestamp '2024-01-18' then 1 else 0 end pm2_5, pm10, aqi from a"
       " where ts between timestamp '2024-01-03 05:00:00' and timestamp '2024-01-28 17:00:00'")
def store_roundtrip(spark, sf_dir):
    rows = fx.with_aqi(spark, sf_dir)
    cut = instant(rows, "2024-01-20 00:00:00")
    table = _new_store(spark, "store").init()
    table.save(rows.where(F.col("ts") < cut))
    later = rows.where(F.col("ts") >= instant(rows, "2024-01-18 00:00:00"))
    table.save(later.withColumn("pm2_5", F.col("pm2_5") + 1).withColumn("junk", F.lit(1)))
    table.snapshot("airspark_snapshot")
    return table.read("2024-01-03 05:00:00", "2024-01-28 17:00:00", columns=["station_id", "ts", "pm2_5", "pm10", "aqi"])


@query(f"with {OBS} select station_id, ts, pm2_5, case when ts < timestamp '2024-01-20' then pm10 end humidity from obs")
def schema_evolution(spark, sf_dir):
    """A column that one instance adds outlives saves of another instance that does not know it."""
    rows = fx.with_aqi(spark, sf_dir)
    root = scratch_path(spark, "evolving")
    wider = store.FeatureStore(spark, root).init().append_features(T.StructType([T.StructField("humidity", T.DoubleType())]))
    cut = instant(rows, "2024-01-20 00:00:00")
    wider.save(rows.where(F.col("ts") < cut).withColumn("humidity", F.col("pm10")))
    store.FeatureStore(spark, root).save(rows.where(F.col("ts") >= cut))
    return store.FeatureStore(spark, root).read(columns=["station_id", "ts", "pm2_5", "humidity"])


@query(f"with {OBS} select station_id, ts, pm2_5 + 3 pm2_5, cast(3 as int) \"version\" from obs")
def latest_version(spark, sf_dir):
    obs = fx.observations(spark, sf_dir).select("station_id", "ts", "pm2_5")
    versions = obs.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    path = scratch_path(spark, "versions")
    versions.withColumn("pm2_5", F.col("pm2_5") + F.col("version")).write.partitionBy("version").parquet(path)
    return store.latest_version(spark.read.parquet(path))


@query(f"with {OBS} select station_id, count(*) \"rows\", cast(14 as int) \"columns\", min(ts) first_ts, max(ts) last_ts,"
       " cast(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) as bigint) span_days from obs group by 1")
def migrate_store(spark, sf_dir):
    rows = fx.with_aqi(spark, sf_dir)
    source = rows.withColumn("text_ts", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).drop("ts")
    return store.migrate(source, _new_store(spark, "target"), "text_ts")


@query(f"with {OBS} select station_id, ts, {COLUMNS} from obs where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-21'")
def export_csv(spark, sf_dir):
    rows = store.date_range(fx.observations(spark, sf_dir), "2024-01-10", "2024-01-20")
    path = store.export_csv(rows, scratch_path(spark, "csv"))
    return spark.read.schema(rows.schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


# ---- filters --------------------------------------------------------------

@query(f"with {OBS} select * from obs where ts between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-12 18:00:00'")
def range_read(spark, sf_dir):
    return store.time_range(fx.observations(spark, sf_dir), "2024-01-05 06:00:00", "2024-01-12 18:00:00")


@query(f"with {OBS} select * from obs where ts >= {NOW_SQL} - interval '7 days'")
def recent_window(spark, sf_dir):
    return store.recent_window(fx.observations(spark, sf_dir), fx.NOW, hours=7 * 24)


@query(f"with {OBS} select * from obs where ts <= {NOW_SQL}")
def actual_rows(spark, sf_dir):
    return store.time_range(fx.observations(spark, sf_dir), end=fx.NOW)


@query(f"with {OBS} select * from obs where cast(ts as date) between date '2024-01-10' and date '2024-01-20'")
def date_range(spark, sf_dir):
    return store.date_range(fx.observations(spark, sf_dir), "2024-01-10", "2024-01-20")


@query(f"with {OBS} select * from obs where pm2_5 is not null and pm10 is not null and no2 is not null")
def complete_rows(spark, sf_dir):
    return quality.complete_rows(fx.observations(spark, sf_dir))


# ---- newest rows ----------------------------------------------------------

@query(f"with {OBS}, n as (select *, row_number() over (partition by station_id order by ts desc) r from obs) select station_id, ts, {COLUMNS} from n where r <= 168")
def tail_n(spark, sf_dir):
    return series.last_rows(fx.observations(spark, sf_dir), 168)


@query(f"with {OBS}, n as (select *, ts <= {_EARLY} is_actual, row_number() over (partition by station_id order by ts <= {_EARLY} desc, ts desc) r from obs)"
       f" select station_id, ts, {COLUMNS}, is_actual from n where r = 1")
def latest_actual(spark, sf_dir):
    return store.newest_actual(fx.observations(spark, sf_dir), "2024-01-01 01:00:00")


@query(f"with {OBS}, n as (select *, ts <= timestamp '2024-01-03' is_actual, row_number() over (partition by station_id order by ts <= timestamp '2024-01-03' desc, ts desc) r from obs)"
       f" select station_id, ts, {COLUMNS}, is_actual from n where r = 1")
def latest_actual_whole(spark, sf_dir):
    """The newest actual row of every station, from all rows."""
    return store.newest_actual(fx.observations(spark, sf_dir), "2024-01-03 00:00:00")


@query(f"with {WITH_AQI}, n as (select *, row_number() over (partition by station_id order by ts desc) r from a where ts <= {NOW_SQL})"
       f" select station_id, cast(11 - r as int) place, ts, aqi, printf('%.1fh ago', (epoch_us({NOW_SQL}) - epoch_us(ts)) / 3600000000.0) age from n where r <= 10")
def last_points(spark, sf_dir):
    rows = fx.actual(fx.with_aqi(spark, sf_dir))
    newest = series.last_rows(rows, 10, rank="r")
    age = F.format_string("%.1fh ago", hours_between(instant(rows, fx.NOW), F.col("ts")))
    return newest.select("station_id", (F.lit(11) - F.col("r")).alias("place"), "ts", "aqi", age.alias("age")).orderBy("station_id", "place")


# ---- union and upsert -----------------------------------------------------

@query(f"with {OBS} select station_id, ts, pm2_5, pm10, cast(null as double) co from obs where ts < timestamp '2024-01-20' union all"
       " select station_id, ts, pm2_5, cast(null as double), co from obs where ts >= timestamp '2024-01-18'")
def union_obs(spark, sf_dir):
    obs = fx.observations(spark, sf_dir)
    old = obs.where(F.col("ts") < instant(obs, "2024-01-20 00:00:00")).select("station_id", "ts", "pm2_5", "pm10")
    new = obs.where(F.col("ts") >= instant(obs, "2024-01-18 00:00:00")).select("station_id", "ts", "pm2_5", "co")
    return merge.union_by_name(old, new)


@query(f"with {OBS} select station_id, ts, pm2_5 + case when ts >= timestamp '2024-01-25' then 2 when ts >= timestamp '2024-01-18' then 1 else 0 end pm2_5, pm10, o3, no2, so2, co from obs")
def upsert(spark, sf_dir):
    obs = fx.observations(spark, sf_dir)
    stored = obs.where(F.col("ts") < instant(obs, "2024-01-20 00:00:00"))
    first = obs.where(F.col("ts") >= instant(obs, "2024-01-18 00:00:00")).withColumn("pm2_5", F.col("pm2_5") + 1)
    again = obs.where(F.col("ts") >= instant(obs, "2024-01-25 00:00:00")).withColumn("pm2_5", F.col("pm2_5") + 2)
    batch = first.withColumn("pos", F.lit(0)).unionByName(again.withColumn("pos", F.lit(1)))
    return merge.upsert(stored, batch, position="pos")


# ---- jobs -----------------------------------------------------------------

_ALL = f"station_id, ts, {COLUMNS}, hour, day, month, aqi"


@query(f"with {WITH_AQI}, n as (select *, row_number() over (partition by station_id order by ts > {NOW_SQL}, abs(epoch_us(ts) - epoch_us({NOW_SQL}))) r from a),"
       " c as (select * from n where r = 1), h as (select c.station_id, max_by(a.aqi, a.ts) prev from c join a on a.station_id = c.station_id"
       " and a.ts < c.ts and a.ts >= c.ts - interval '2 hours' group by 1)"
       f" select {_ALL}, {q6('case when aqi = 0 or prev is null or prev <= 0 then 0.0 else (aqi - prev)::double / prev end')} aqi_change_rate,"
       f" {NOW_SQL} ingestion_timestamp from c left join h using (station_id)")
def hourly_ingest(spark, sf_dir):
    rows = fx.with_aqi(spark, sf_dir)
    payloads = payload.payload_json(daily_payloads(rows), BY)
    return rounded(jobs.hourly_ingest(payloads, rows, fx.NOW), "aqi_change_rate")


@query(f"with {WITH_AQI}, c as (select *, {CHUNK_SQL} chunk_id from a where ts >= timestamp '2024-01-05'),"
       " p as (select *, lag(pm2_5) over (partition by station_id, chunk_id order by ts) prev from c)"
       f" select {_ALL}, {q6('coalesce((pm2_5 - prev) / nullif(prev + 1e-6, 0), 0)')} aqi_change_rate, {NOW_SQL} ingestion_timestamp from p"
       f" union all select station_id, ts, pm2_5 + 1, {', '.join(P[1:])}, hour, day, month, aqi, null, null from a where ts < timestamp '2024-01-05'")
def backfill_job(spark, sf_dir):
    rows = fx.with_aqi(spark, sf_dir)
    start, overlap = instant(rows, "2024-01-05 00:00:00"), instant(rows, "2024-01-10 00:00:00")
    payloads = payload.payload_json(daily_payloads(rows.where(F.col("ts") >= start)), BY)
    stored = quality.align_schema(rows.where(F.col("ts") < overlap).withColumn("pm2_5", F.col("pm2_5") + 1), FEATURE_TABLE)
    return rounded(merge.upsert(stored, jobs.backfill(payloads, fx.START, fx.NOW)), "aqi_change_rate")
