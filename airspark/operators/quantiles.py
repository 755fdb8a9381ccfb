"""Exact quantiles without holding a group's values in one task.

``percentile`` keeps all distinct values of a group in one aggregation buffer.
Here values are first counted per narrow bin, which tasks do before the shuffle.
The running counts of the bins tell which few bins hold a wanted rank, and only
the rows of those bins are counted by value and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airspark.operators.series import bucket_offsets
from airspark.operators.steps import counted_bins, holds_any, quantile_values, steps, value_bucket
from airspark.schema import STATION

__all__ = ["equal_width_bin", "long_values", "quantiles", "split_quantiles", "value_bucket", "value_edges"]


def long_values(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per key, column name and value present."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return long.unpivot(keys, columns, "feature", "value").where(F.col("value").isNotNull())


def value_edges(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Smallest and largest value of each column, one row per key and column."""
    edges = df.groupBy(*keys).agg(
        *[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in columns]
    )
    return edges.unpivot(keys, columns, "feature", "_e").select(*keys, "feature", "_e.low", "_e.high")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number from 0; the last bin is closed."""
    width = (high - low) / F.lit(float(bins))
    return F.least(F.coalesce(F.floor(F.try_divide(value - low, width)), F.lit(0)), F.lit(bins - 1)).cast("int")


def interpolated(lo: Column, hi: Column, part: Column) -> Column:
    """The value ``part`` of the way from ``lo`` to ``hi``, weighed: their difference would be rounded
    before it is scaled, and a value that is the quantile itself could fall outside by the last bit."""
    return F.when(lo < hi, lo * (1 - part) + hi * part).otherwise(lo)


def quantiles(
    df: DataFrame, columns: list[str], probabilities: dict[str, float], keys: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles: one row per key and ``feature``.

    The column ``name`` holds the quantile ``probabilities[name]``; ``n`` is the
    number of values present.
    """
    keys = keys or [STATION]
    by = [*keys, "feature"]
    long = long_values(df, columns, keys).withColumn("_b", value_bucket(F.col("value")))
    offsets = bucket_offsets(long, by, {"n": F.lit(1).cast("bigint")})
    spot = {name: F.lit(p) * (F.col("n_total") - 1) for name, p in probabilities.items()}
    wanted = F.array(*[f(s).cast("bigint") for s in spot.values() for f in (F.floor, F.ceil)])
    first, last = F.col("_before_n"), F.col("_before_n") + F.col("_in_n")
    hit = offsets.where(F.exists(wanted, lambda k: (k >= first) & (k < last)))
    near = long.join(hit, [*by, "_b"]).groupBy(*by, "_b", "_before_n", "n_total", "value").agg(F.count("*").alias("n"))
    inside = Window.partitionBy(*by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = near.withColumn("_to", F.col("_before_n") + F.sum("n").over(inside)).withColumn("_from", F.col("_to") - F.col("n"))

    def at(rank: Column) -> Column:
        rank = rank.cast("bigint")
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("value")))

    picked = ranked.groupBy(*by, F.col("n_total").alias("n")).agg(
        *[x for name, s in spot.items() for x in (at(F.floor(s)).alias(f"_{name}_lo"), at(F.ceil(s)).alias(f"_{name}_hi"))]
    )
    out = []
    for name, p in probabilities.items():
        exact = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append(interpolated(lo, hi, exact - F.floor(exact)).alias(name))
    return picked.select(*by, "n", *out)


def split_quantiles(
    df: DataFrame, columns: list[str], probabilities: dict[str, float], keys: list[str] | None = None
) -> DataFrame:
    """``quantiles`` for columns that may be nearly constant: crowded bins are split before their values are sorted.

    Jobs run when it is called (bins are counted and written); ``quantiles`` runs none.
    """
    keys = keys or [STATION]
    by, counts = [*keys, "feature"], {"n": F.lit(True)}
    long = long_values(df, columns, keys)
    near = holds_any(list(probabilities.values()))
    exact = steps(long, counted_bins(long, by, counts), by, counts, lambda parts: parts.withColumn("near", near))
    found = quantile_values(exact, by, {name: (p, "n") for name, p in probabilities.items()})
    return found.withColumnRenamed("total_n", "n")
