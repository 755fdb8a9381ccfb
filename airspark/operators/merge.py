"""Union and upsert of observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airspark.schema import STATION, TS

KEY = [STATION, TS]


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; a column that one side lacks is NULL there."""
    return a.unionByName(b, allowMissingColumns=True)


def keep_last(df: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    """One row per key, the one that is last by ``order``.

    Spark limits each key to one row before the shuffle as well, so many copies
    of one key never meet in one task.
    """
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_last", F.row_number().over(w)).where(F.col("_last") == 1).drop("_last", *order)


def upsert(stored: DataFrame, batch: DataFrame, position: str | None = None, key: list[str] = KEY) -> DataFrame:
    """Stored and new rows; a new row replaces the stored row of its key.

    ``position`` orders repeats within the batch: the last one wins.
    """
    at = F.col(position).cast("bigint") if position else F.lit(0).cast("bigint")
    old = stored.withColumns({"_source": F.lit(0), "_position": F.lit(0).cast("bigint")})
    new = batch.withColumns({"_source": F.lit(1), "_position": at})
    both = union_by_name(old, new.drop(position) if position else new)
    return keep_last(both, ["_source", "_position"], key)
