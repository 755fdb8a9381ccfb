"""Least squares for many groups: sums on Spark, one tiny solve per group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def gram(df: DataFrame, keys: list[str], y: Column, xs: list[Column]) -> DataFrame:
    """Sums of products per group; tasks add up their rows before the shuffle.

    Columns: ``n``, ``xtx`` (upper triangle by rows), ``xty`` and ``yy``. Rows
    with a missing value in ``y`` or any of ``xs`` must be filtered out before.
    """
    pairs = list(combinations_with_replacement(range(len(xs)), 2))
    named = df.select(*keys, y.cast("double").alias("_y"), *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(xs)])
    sums = named.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_a{k}") for k, (i, j) in enumerate(pairs)],
        *[F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"_b{i}") for i in range(len(xs))],
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )
    return sums.select(
        *keys,
        "n",
        F.array(*[f"_a{k}" for k in range(len(pairs))]).alias("xtx"),
        F.array(*[f"_b{i}" for i in range(len(xs))]).alias("xty"),
        "yy",
    )


def solve(sums: DataFrame, size: int) -> DataFrame:
    """Add ``coef`` and the residual sum ``rss`` to rows made by ``gram``.

    All rows of an Arrow batch are solved together. A regressor that is zero or
    repeats another gets the shortest solution.
    """
    upper = np.triu_indices(size)
    kept = [f for f in sums.schema if f.name not in ("xtx", "xty", "yy")]
    schema = T.StructType(
        kept + [T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("rss", T.DoubleType())]
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            a = np.zeros((len(batch), size, size))
            a[:, upper[0], upper[1]] = np.stack(batch["xtx"].to_numpy())
            a[:, upper[1], upper[0]] = a[:, upper[0], upper[1]]
            b = np.stack(batch["xty"].to_numpy())
            coef = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
            out = batch[[f.name for f in kept]].copy()
            out["coef"] = list(coef)
            out["rss"] = np.maximum(batch["yy"].to_numpy() - np.einsum("ni,ni->n", coef, b), 0.0)
            yield out

    return sums.mapInPandas(fit, schema)


def grouped_least_squares(df: DataFrame, keys: list[str], y: Column, xs: list[Column]) -> DataFrame:
    return solve(gram(df, keys, y, xs), len(xs))


def _group_starts(columns: list[pa.Array]) -> np.ndarray:
    """Where runs of rows with equal keys begin; nulls are equal."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        now, before = c.slice(1), c.slice(0, len(c) - 1)
        unlike = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(pc.is_null(now), pc.is_null(before)))
        new[1:] |= np.asarray(unlike)
    return np.flatnonzero(new)


def wide_gram(df: DataFrame, keys: list[str], y: Column, xs: Column) -> DataFrame:
    """``gram`` for many regressors, given as one array column: tasks multiply whole batches.

    Every task hands on one row of sums per group and batch, so a group with very many rows
    is no larger a task than any other; batches should hold few groups, as ``df`` has them
    together. Rows with a missing entry must be filtered out before.
    """
    named = df.select(*keys, y.cast("double").alias("_y"), xs.cast("array<double>").alias("_x"))
    fields = [f for f in named.schema if f.name in keys]
    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("all", arrays)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(len(keys) + 1).flatten()).reshape(batch.num_rows, -1)
            whole = np.column_stack((x, np.asarray(batch.column(len(keys)))))
            upper = np.triu_indices(whole.shape[1])
            table = pa.table({k: batch.column(i) for i, k in enumerate(keys)}).append_column("_row", pa.array(np.arange(batch.num_rows)))
            groups = table.group_by(keys).aggregate([("_row", "list")])
            out = []
            for rows in groups.column("_row_list").to_pylist():
                part = whole[rows]
                out.append((len(rows), (part.T @ part)[upper].tolist()))
            columns = [groups.column(k).combine_chunks() for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([n for n, _ in out]), pa.array([a for _, a in out], pa.list_(pa.float64()))], names=[*keys, "n", "all"]
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the sums of a group that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            starts = _group_starts([whole.column(k) for k in keys])
            n = np.add.reduceat(np.asarray(whole.column("n")), starts)
            entries = np.asarray(whole.column("all").flatten()).reshape(whole.num_rows, -1)
            entries = np.add.reduceat(entries, starts, axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * entries.shape[1], pa.int32()), pa.array(entries.ravel()))
            columns = [whole.column(k).take(pa.array(starts)) for k in keys]
            groups = pa.RecordBatch.from_arrays([*columns, pa.array(n), lists], names=[*keys, "n", "all"])
            held = groups.slice(groups.num_rows - 1)
            yield groups.slice(0, groups.num_rows - 1)
        if held is not None:
            yield held

    # Sums of a group are added as they come by, so that a task holds one batch of them.
    return named.mapInArrow(sums, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def whole_gram(flat: np.ndarray) -> np.ndarray:
    """The symmetric matrix of ``wide_gram``'s sums; its last row and column are y's."""
    size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T
