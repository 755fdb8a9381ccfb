"""Air-quality index expressions, all inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Scale(NamedTuple):
    """Index levels reached at the given concentrations, after unit conversion."""

    factor: float
    divide: bool
    points: tuple[float, ...]


# Index levels and the concentrations that reach them.
LEVELS = (0, 50, 100, 150, 200, 300, 400, 500)
SCALES = {
    "pm2_5": Scale(1.0, False, (0.0, 12.0, 35.4, 55.4, 150.4, 250.4, 350.4, 500.4)),
    "pm10": Scale(1.0, False, (0.0, 54.0, 154.0, 254.0, 354.0, 424.0, 504.0, 604.0)),
    "o3": Scale(0.0005, False, (0.0, 0.054, 0.070, 0.085, 0.105, 0.200, 0.404, 0.604)),
    "no2": Scale(0.00053, False, (0.0, 0.053, 0.100, 0.360, 0.649, 1.249, 1.649, 2.049)),
    "so2": Scale(0.00038, False, (0.0, 0.034, 0.144, 0.224, 0.304, 0.604, 0.804, 1.004)),
    "co": Scale(1000.0, True, (0.0, 4.4, 9.4, 12.4, 15.4, 30.4, 40.4, 50.4)),
}
TOP = 500.0

# Bands of the index.
BANDS = (
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
)
TOP_BAND = "Hazardous"
CARD_BANDS = ((50, "Good"), (100, "Moderate"), (150, "Unhealthy (SG)"))
CARD_TOP = "Unhealthy"

# Segments of the PM2.5-only index (from, to, index at from, rise).
PM_SEGMENTS = (
    (0.0, 12.0, 0.0, 50.0),
    (12.0, 35.4, 50.0, 50.0),
    (35.4, 55.4, 100.0, 50.0),
    (55.4, 150.4, 150.0, 50.0),
)
PM_TAIL = (150.4, 250.4, 200.0, 100.0)
PM_CAP = 300


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _subindex_text(c: str, points, levels=LEVELS) -> str:
    """SQL text, parsed in one call: far cheaper to build than nested columns."""
    known = f"nanvl({c}, cast(null as double))"
    arms = [f"when {known} < 0 then 0D"]
    for low, high, base, top in zip(points, points[1:], levels, levels[1:]):
        slope = (top - base) / (high - low)
        arms.append(f"when {known} <= {_number(high)} then {_number(slope)} * ({c} - {_number(low)}) + {_number(base)}")
    # Missing fails every comparison and ends at the 0 of ``coalesce``.
    arms.append(f"when {known} is not null then {_number(TOP)}")
    return f"coalesce(bround(case {' '.join(arms)} end, 0), 0D)"


def _pollutant_text(name: str, column: str) -> str:
    scale = SCALES[name]
    c = f"`{column}`"
    if scale.divide:
        converted = f"({c} / {_number(scale.factor)})"
    else:
        converted = c if scale.factor == 1.0 else f"({c} * {_number(scale.factor)})"
    known = f"nanvl({c}, cast(null as double)) is not null"
    return f"case when {known} then {_subindex_text(converted, scale.points)} end"


def subindex(column: str, points=SCALES["pm2_5"].points, levels=LEVELS) -> Column:
    """Piecewise-linear index of one converted concentration.

    Missing or negative gives 0, beyond the last point gives 500, and halves
    round to the even neighbour.
    """
    return F.expr(_subindex_text(f"`{column}`", points, levels))


def pollutant_index(name: str, column: str | None = None) -> Column:
    """Index of one stored concentration (µg/m³), NULL where it is missing."""
    return F.expr(_pollutant_text(name, column or name))


def aqi(names: dict[str, str] | None = None) -> Column:
    """Index over all pollutants present; 0 when none is."""
    parts = [_pollutant_text(n, c) for n, c in (names or {n: n for n in SCALES}).items()]
    worst = f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0]
    return F.expr(f"cast(coalesce({worst}, 0D) as int)")


def aqi_particles(pm2_5: str = "pm2_5", pm10: str = "pm10") -> Column:
    """Index over the two particle measures only."""
    return aqi({"pm2_5": pm2_5, "pm10": pm10})


def pm25_to_aqi(pm2_5: Column) -> Column:
    """PM2.5-only index: truncated, extended above the table, capped."""
    x = F.greatest(F.lit(0.0), F.nanvl(pm2_5, F.lit(0.0)))
    value = F
    for low, high, base, rise in PM_SEGMENTS:
        value = value.when(x <= high, F.lit(base) + (x - F.lit(low)) / F.lit(high - low) * F.lit(rise))
    low, high, base, rise = PM_TAIL
    tail = F.lit(base) + (x - F.lit(low)) / F.lit(high - low) * F.lit(rise)
    capped = F.least(F.lit(PM_CAP), F.floor(value.otherwise(tail)).cast("int"))
    return F.when(pm2_5.isNotNull(), capped)


def _bands(value: Column, bands, top: str) -> Column:
    missing = F.when(value.isNull(), F.lit(None).cast("string"))
    return reduce(lambda acc, b: acc.when(value <= b[0], F.lit(b[1])), bands, missing).otherwise(F.lit(top))


def category(value: Column) -> Column:
    return _bands(value, BANDS, TOP_BAND)


def card_status(value: Column) -> Column:
    return _bands(value, CARD_BANDS, CARD_TOP)


def resolved(stored: Column, names: dict[str, str] | None = None) -> Column:
    """Stored index, computed from the pollutants where it is missing."""
    return F.coalesce(stored.cast("int"), aqi(names))
