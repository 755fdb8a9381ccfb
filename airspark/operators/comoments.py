"""Correlations of many pairs of columns from sums that merge, in one pass over the rows.

A task reduces each of its batches to one row per station with the counts, means and
centred sums of all pairs (matrix products in numpy). Those rows are a small table; their
means are merged first and their sums then, around the merged means, so that nothing is
lost by cancellation and no group is larger a task than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from airspark.functions.numbers import ratio
from airspark.schema import STATION
from airspark.session import written

FIELDS = ["n", "mean_x", "mean_y", "sxy", "sxx", "syy", "min_x", "max_x", "min_y", "max_y"]


def batch_moments(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The fields of the pairs (left[i], right[i]) of columns; NaN marks a missing value."""
    there = ~np.isnan(values)
    mask = there.astype(float)
    counts = mask.sum(axis=0)
    middle = np.where(there, values, 0.0).sum(axis=0) / np.maximum(counts, 1)
    z = np.where(there, values - middle, 0.0)
    n, sums, squares, products = mask.T @ mask, z.T @ mask, (z * z).T @ mask, z.T @ z
    some = np.maximum(n, 1)
    low, high = np.empty_like(n), np.empty_like(n)
    for j in range(values.shape[1]):
        rows = there & there[:, j : j + 1]
        low[:, j] = np.where(rows, values, np.inf).min(axis=0)
        high[:, j] = np.where(rows, values, -np.inf).max(axis=0)
    mean = middle[:, None] + sums / some
    i, j = left, right
    return np.stack(
        [
            n[i, j], mean[i, j], mean[j, i],
            products[i, j] - sums[i, j] * sums[j, i] / some[i, j],
            squares[i, j] - sums[i, j] ** 2 / some[i, j], squares[j, i] - sums[j, i] ** 2 / some[i, j],
            low[i, j], high[i, j], low[j, i], high[j, i],
        ],
        axis=1,
    )


def merged_comoments(parts: DataFrame) -> DataFrame:
    """station_id, a, b and Pearson's ``r`` of rows with the pair's fields; NULL for a constant side.

    A pair without common rows keeps a row. Equal extremes tell a constant: its sums of
    squares are not always exactly zero.
    """
    by, c = [STATION, "a", "b"], F.col
    full = c("n") > 0
    some = lambda name: F.when(full, c(name))
    total = F.sum("n")
    means = parts.groupBy(*by).agg(
        total.alias("_n"),
        *[ratio(F.sum(some("n") * some(f"mean_{s}")), total).alias(f"_{s}") for s in "xy"],
        ((F.min(some("min_x")) < F.max(some("max_x"))) & (F.min(some("min_y")) < F.max(some("max_y")))).alias("_spread"),
    )
    dx, dy = c("mean_x") - c("_x"), c("mean_y") - c("_y")
    sums = (
        parts.where(full)
        .join(means, by)
        .groupBy(*by)
        .agg(
            F.sum(c("sxy") + c("n") * dx * dy).alias("sxy"),
            F.sum(c("sxx") + c("n") * dx * dx).alias("sxx"),
            F.sum(c("syy") + c("n") * dy * dy).alias("syy"),
        )
    )
    r = F.when(c("_spread"), ratio(c("sxy"), F.sqrt(c("sxx") * c("syy"))))
    return means.join(sums, by, "left").select(*by, r.alias("r"))


def comoments(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlation of every pair per station: station_id, a, b, r."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    left = np.array([columns.index(a) for a, _ in pairs])
    right = np.array([columns.index(b) for _, b in pairs])
    reduce = batch_moments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            code = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float)[order]
            parts = np.concatenate([reduce(rows, left, right) for rows in np.split(values, starts[1:])])
            stations = batch.column(0).take(pa.array(order[starts].repeat(len(left))))
            number = np.tile(np.arange(len(left), dtype=np.int32), len(starts))
            yield pa.RecordBatch.from_arrays([stations, pa.array(number), *map(pa.array, parts.T.copy())], names=[STATION, "_pair", *FIELDS])

    kind = df.schema[STATION].dataType.simpleString()
    doubles = df.select(STATION, *[F.col(c).cast("double").alias(c) for c in columns])
    schema = f"{STATION} {kind}, _pair int, " + ", ".join(f"{f} double" for f in FIELDS)
    table = written(doubles.mapInArrow(run, schema), "moments")
    name = lambda side: F.array(*[F.lit(pair[side]) for pair in pairs])[F.col("_pair")]
    return merged_comoments(table.withColumns({"a": name(0), "b": name(1)}))
