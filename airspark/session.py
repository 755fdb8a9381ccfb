"""Session settings shared by jobs, queries and tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that drops the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings every plan relies on: UTC days and hours, AQE on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def one_machine(master: str) -> bool:
    """Whether driver and tasks share one process; ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def _shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a local one when none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not one_machine(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = os.environ.get("AIRSPARK_TEST_DIR") or tempfile.mkdtemp(prefix="airspark-")
        os.environ["AIRSPARK_TEST_DIR"] = root
    return root.rstrip("/")


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_root(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path on shared storage for a table that later steps read back."""
    return f"{_shared_root(spark)}/airspark-{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go as soon as it is complete."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def compressed(spark: SparkSession) -> Iterator[None]:
    """Within it, tables are written smaller, for more CPU time."""
    name = "spark.sql.parquet.compression.codec"
    before = spark.conf.get(name)
    spark.conf.set(name, "zstd")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table on shared storage: computed once, pruned by column on every read.

    For results that several later passes read. Lost executors only repeat reads, so
    the shuffle files behind the table go as soon as it is complete.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        # A plan of its own, so that no later action on ``df`` misses its files.
        df.select("*").write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def dropped(table: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    discard(table.sparkSession, table.scratch)
