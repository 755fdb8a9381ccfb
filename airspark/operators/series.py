"""Ordered operations over series of any length, without one task per series.

A plain ``Window.partitionBy(station).orderBy(ts)`` sends a whole station to one
task. One station may hold a large share of all rows, so ordered work is cut
into pieces of bounded size here, and the pieces are made exact:

* ``running_totals`` adds cumulative sums (and row numbers) in two levels: sums
  per bucket, prefix sums over the few bucket rows, then sums inside a bucket.
* ``row_windowed`` cuts each series into blocks of a fixed number of rows and
  copies the rows a frame needs across each cut.
* ``range_windowed`` does the same for frames in time, in a single shuffle.

Cuts depend on the data alone, so a task that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from airspark.functions.timefn import DAY_US, floor_div, micros
from airspark.schema import STATION, TS

BLOCK_ROWS = 8_192


def day_bucket(ts: str = TS, days: int = 1) -> Column:
    """Time bucket for two-level sums; a day bounds the rows of one task."""
    return floor_div(micros(F.col(ts)), DAY_US * days)


def _inclusive(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def bucket_offsets(bucketed: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """One row per key and ``_b``: sums of earlier buckets and of the whole key."""
    totals = bucketed.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_in_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    return totals.select(
        *keys,
        "_b",
        *[F.col(f"_in_{n}") for n in sums],
        *[F.coalesce(F.sum(f"_in_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(f"_in_{n}").over(everything).alias(f"{n}_total") for n in sums],
    )


def running_totals(
    df: DataFrame,
    sums: dict[str, Column],
    bucket: Column,
    keys: list[str],
    order: list,
    totals: bool = True,
) -> DataFrame:
    """Add the inclusive running sum ``name`` and ``name_total`` for every entry.

    ``bucket`` must be non-decreasing along ``order`` within a key.
    """
    made = [m for n in sums for m in (n, f"{n}_total")]
    bucketed = df.withColumn("_b", bucket).drop(*made)
    offsets = bucket_offsets(bucketed, keys, sums)
    inside = _inclusive(Window.partitionBy(*keys, "_b").orderBy(*order))
    out = bucketed.join(offsets, [*keys, "_b"]).withColumns(
        {n: F.col(f"_before_{n}") + F.sum(c).over(inside) for n, c in sums.items()}
    )
    drop = ["_b"] + [f"_{p}_{n}" for n in sums for p in ("in", "before")]
    if not totals:
        drop += [f"{n}_total" for n in sums]
    return out.drop(*drop)


def numbered(
    df: DataFrame,
    keys: list[str] | None = None,
    order: list | None = None,
    bucket: Column | None = None,
    name: str = "rn",
) -> DataFrame:
    """Add the row number of each row in its series, and the series length."""
    return running_totals(
        df,
        {name: F.lit(1).cast("bigint")},
        day_bucket() if bucket is None else bucket,
        keys or [STATION],
        order or [TS],
    )


def row_windowed(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    keys: list[str] | None = None,
    order: list | None = None,
    bucket: Column | None = None,
    block_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Add the columns of ``build(window)``, whose frames count rows.

    ``before`` and ``after`` say how many rows the frames look back and ahead.
    Every row of a series is computed from its true neighbours, however sparse
    the series is, because the blocks hold a fixed number of rows. With
    ``block_rows=None`` a series is one block, for callers that know that all
    their series are short.
    """
    keys, order = keys or [STATION], order or [TS]
    if block_rows is None:
        return df.withColumns(build(Window.partitionBy(*keys).orderBy(*order)))
    if block_rows < max(before, after, 1):
        raise ValueError("a block must hold at least the rows a frame reaches over")
    place = F.col("_rn") - 1
    own = floor_div(place, block_rows)
    inside = F.pmod(place, F.lit(block_rows))
    homes = [own]
    if before:
        homes.append(F.when(inside >= block_rows - before, own + 1))
    if after:
        homes.append(F.when((inside < after) & (own > 0), own - 1))
    blocks = (
        numbered(df, keys, order, bucket, name="_rn")
        .withColumn("_own", own)
        .withColumn("_block", F.explode(F.array(*homes)))
        .where(F.col("_block").isNotNull())
    )
    window = Window.partitionBy(*keys, "_block").orderBy("_rn")
    out = blocks.withColumns(build(window)).where(F.col("_block") == F.col("_own"))
    return out.drop("_rn", "_rn_total", "_own", "_block")


def range_windowed(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    before_us: int = 0,
    after_us: int = 0,
    keys: list[str] | None = None,
    ts: str = TS,
    slice_us: int = 32 * DAY_US,
) -> DataFrame:
    """Add the columns of ``build(window)``, whose frames span microseconds.

    Series are cut at fixed instants; rows within reach of a cut are copied to
    the slice that looks at them. One shuffle, no counting pass.
    """
    keys = keys or [STATION]
    if slice_us < max(before_us, after_us):
        raise ValueError("a slice must be at least as long as a frame reaches")
    own = floor_div(F.col("_us"), slice_us)
    inside = F.pmod(F.col("_us"), F.lit(slice_us))
    homes = [own]
    if before_us:
        homes.append(F.when(inside >= slice_us - before_us, own + 1))
    if after_us:
        homes.append(F.when(inside <= after_us, own - 1))
    slices = (
        df.withColumn("_us", micros(F.col(ts)))
        .withColumn("_own", own)
        .withColumn("_slice", F.explode(F.array(*homes)))
        .where(F.col("_slice").isNotNull())
    )
    window = Window.partitionBy(*keys, "_slice").orderBy("_us")
    out = slices.withColumns(build(window)).where(F.col("_slice") == F.col("_own"))
    return out.drop("_us", "_own", "_slice")


def last_rows(df: DataFrame, n: int, keys: list[str] | None = None, ts: str = TS, rank: str | None = None) -> DataFrame:
    """The newest ``n`` rows of each series; tasks keep only ``n`` per series before the shuffle."""
    w = Window.partitionBy(*(keys or [STATION])).orderBy(F.col(ts).desc())
    name = rank or "_newest"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)
