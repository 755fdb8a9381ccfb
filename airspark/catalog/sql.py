"""SQL fragments shared by the check queries."""

from __future__ import annotations

from airspark.fixtures import NOW, RECENT_FROM, USERS_PER_STATION
from airspark.functions.aqi import LEVELS, PM_CAP, PM_SEGMENTS, PM_TAIL, SCALES

OBS = f"""obs as (
  select cast(floor(user_id / {USERS_PER_STATION}) as int) station_id, date_trunc('hour', ts) ts,
    cast(sum(cast(value as decimal(18,2))) as double) / count(*) pm2_5,
    max(case when event_type <> 'error' then value end) pm10,
    cast(sum(cast(value as decimal(18,2))) as double) o3,
    cast(sum(case when event_type <> 'signup' then cast(value as decimal(18,2)) end) as double) no2,
    min(value) so2,
    100 * cast(sum(cast(value as decimal(18,2))) as double) / count(*) co
  from events group by 1, 2)"""

NOW_SQL = f"timestamp '{NOW}'"
RECENT_SQL = f"timestamp '{RECENT_FROM}'"


def subindex_sql(expr: str, points) -> str:
    arms = [f"when {expr} is null or {expr} < 0 then 0.0"]
    for low, high, base, top in zip(points, points[1:], LEVELS, LEVELS[1:]):
        arms.append(
            f"when {expr} between {low}::double and {high}::double then round_even("
            f"({top - base}::double / ({high}::double - {low}::double)) * ({expr} - {low}::double) + {base}, 0)"
        )
    return "case " + " ".join(arms) + " else 500.0 end"


def part_sql(name: str, prefix: str = "") -> str:
    s = SCALES[name]
    col = prefix + name
    conv = f"({col} / {s.factor}::double)" if s.divide else f"({col} * {s.factor}::double)"
    return f"case when {col} is not null then {subindex_sql(conv, s.points)} end"


def aqi_sql(names=tuple(SCALES), prefix: str = "") -> str:
    return f"cast(coalesce(greatest({', '.join(part_sql(n, prefix) for n in names)}), 0) as int)"


def pm_aqi_sql(x: str) -> str:
    arms = [f"when {x} <= 0 then 0"]
    for low, high, base, rise in PM_SEGMENTS:
        arms.append(
            f"when {x} <= {high}::double then floor({base}::double + ({x} - {low}::double) / "
            f"({high}::double - {low}::double) * {rise}::double)"
        )
    low, high, base, rise = PM_TAIL
    tail = f"floor({base}::double + ({x} - {low}::double) / ({high}::double - {low}::double) * {rise}::double)"
    return f"cast(least({PM_CAP}, case {' '.join(arms)} else {tail} end) as int)"


TIMED = OBS + """, timed as (
  select *, cast(hour(ts) as int) as hour, cast(day(ts) as int) as day, cast(month(ts) as int) as month from obs)"""
WITH_AQI = TIMED + f", a as (select *, {aqi_sql()} aqi from timed)"
