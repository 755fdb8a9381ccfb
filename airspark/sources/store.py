"""The feature store: versioned Parquet tables partitioned by calendar month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from airspark.functions.timefn import add_hours, instant
from airspark.operators.merge import upsert
from airspark.operators.quality import align_schema, evolve_schema, table_stats, utc_normalise
from airspark.operators.series import last_rows
from airspark.schema import FEATURE_TABLE, STATION, TS
from airspark.session import discard, prepare, scratch_path

MONTH = "month_start"
DEFAULT_VERSION = 3


class FeatureStore:
    """One named table. Rows are keyed by station and timestamp.

    Only months that a batch touches are rewritten. The new content of those
    months is first written to a fresh folder and then moved over month by month,
    so a job never reads what it overwrites, and a lost executor only repeats
    tasks. The columns of the table are stored beside it, so every instance knows columns
    that another one added. Within a month, rows are ordered by station and time, which keeps the
    row-group statistics of both narrow.
    """

    def __init__(self, spark: SparkSession, root: str, version: int = DEFAULT_VERSION, schema: T.StructType = FEATURE_TABLE):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self.version = version
        self.given = schema

    @property
    def schema(self) -> T.StructType:
        """The stored columns followed by those of this instance that are new."""
        stored = self._stored_schema()
        return self.given if stored is None else evolve_schema(stored, self.given)

    @property
    def _schema_path(self) -> str:
        # Names that begin with an underscore are no part of the table's data.
        return f"{self.root}/_schema/version={self.version}"

    def _stored_schema(self) -> T.StructType | None:
        try:
            return self.spark.read.parquet(self._schema_path).schema
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def _store_schema(self, schema: T.StructType) -> None:
        if schema != self._stored_schema():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self._schema_path)

    @property
    def path(self) -> str:
        return f"{self.root}/version={self.version}"

    def init(self) -> "FeatureStore":
        """Create an empty table unless there is one."""
        schema = self.schema
        self._store_schema(schema)
        self._write(self.spark.createDataFrame([], schema), self.path, "ignore")
        return self

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        month = F.trunc(F.col(TS).cast("date"), "month")
        (
            df.withColumn(MONTH, month)
            # AQE splits large months and joins small ones; no month is one task.
            .hint("rebalance", MONTH)
            .sortWithinPartitions(MONTH, STATION, TS)
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(MONTH)
            .parquet(path)
        )

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self._with_month(self.schema)).parquet(self.path)

    @staticmethod
    def _with_month(schema: T.StructType) -> T.StructType:
        return T.StructType(list(schema) + [T.StructField(MONTH, T.DateType())])

    def save(self, batch: DataFrame, position: str | None = None) -> None:
        """Upsert a batch; columns that the table lacks are dropped.

        The batch is computed once; of the stored table only the months it touches are read.
        """
        schema = self.schema
        self._store_schema(schema)
        extra = [T.StructField(position, T.LongType())] if position else []
        arrived, staged = scratch_path(self.spark, "batch"), scratch_path(self.spark, "staged")
        wanted = T.StructType(list(schema) + extra)
        align_schema(batch, wanted).write.parquet(arrived)
        new = self.spark.read.schema(wanted).parquet(arrived)
        # A few scalars: the calendar months of one batch.
        months = [r[0] for r in new.select(F.trunc(F.col(TS).cast("date"), "month")).distinct().collect()]
        touched = self._stored().where(F.col(MONTH).isin(months)).drop(MONTH)
        self._write(upsert(touched, new, position), staged, "errorifexists")
        content = self.spark.read.schema(self._with_month(schema)).parquet(staged)
        content.sortWithinPartitions(MONTH, STATION, TS).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(MONTH).parquet(self.path)
        discard(self.spark, arrived)
        discard(self.spark, staged)

    def append_features(self, wanted: T.StructType) -> "FeatureStore":
        """Add columns to the table; older files read as NULL there."""
        self.given = evolve_schema(self.schema, wanted)
        self._store_schema(self.given)
        return self

    def read(self, start=None, end=None, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a closed time range, the newest ``limit`` per station.

        The bounds reach the scan twice: as month partitions and as row-group
        filters on the timestamp.
        """
        df = self._stored()
        if start is not None:
            at = instant(df, start)
            df = df.where((F.col(TS) >= at) & (F.col(MONTH) >= F.trunc(at.cast("date"), "month")))
        if end is not None:
            at = instant(df, end)
            df = df.where((F.col(TS) <= at) & (F.col(MONTH) <= F.trunc(at.cast("date"), "month")))
        df = df.drop(MONTH)
        if limit is not None:
            df = last_rows(df, limit)
        return df.select(*columns) if columns else df

    def recent(self, now, hours: int = 24) -> DataFrame:
        at = F.lit(str(now)).cast("timestamp_ntz")
        return self.read(start=add_hours(at, F.lit(-hours)))

    def latest(self) -> DataFrame:
        return self.read(limit=1)

    def snapshot(self, view: str, required: str = "pm2_5") -> DataFrame:
        """Register the whole table as a view; without ``required``, from its files' own schema."""
        df = self.read()
        if required not in df.columns:
            df = self.spark.read.parquet(self.path).drop(MONTH)
        df.createOrReplaceTempView(view)
        return df


def time_range(df: DataFrame, start=None, end=None, ts: str = TS) -> DataFrame:
    """Rows between two instants, both included, either one open."""
    if start is not None:
        df = df.where(F.col(ts) >= instant(df, start, ts))
    if end is not None:
        df = df.where(F.col(ts) <= instant(df, end, ts))
    return df


def recent_window(df: DataFrame, now, hours: int = 24, ts: str = TS) -> DataFrame:
    return df.where(F.col(ts) >= add_hours(instant(df, now, ts), F.lit(-hours)))


def date_range(df: DataFrame, first: str, last: str, ts: str = TS) -> DataFrame:
    """Rows of calendar days, both included, as a range that can be pushed down."""
    return df.where((F.col(ts) >= instant(df, f"{first} 00:00:00", ts)) & (F.col(ts) < add_hours(instant(df, f"{last} 00:00:00", ts), F.lit(24))))


def newest_actual(df: DataFrame, now, ts: str = TS) -> DataFrame:
    """Per station the newest row not after ``now``; if all are later, the newest of them."""
    rest = [c for c in df.columns if c != STATION]
    actual = (F.col(ts) <= instant(df, now, ts)).alias("_actual")
    best = df.groupBy(STATION).agg(F.max(F.struct(actual, F.col(ts).alias("_at"), *rest)).alias("_b"))
    return best.select(STATION, *[F.col(f"_b.{c}") for c in rest], F.col("_b._actual").alias("is_actual"))


def latest_version(df: DataFrame, version: str = "version", default: int = DEFAULT_VERSION) -> DataFrame:
    """Rows of the highest version. A first query reads the version alone, so that the second
    reads only that version's partition."""
    highest = df.agg(F.coalesce(F.max(version), F.lit(default))).first()[0]
    return df.where(F.col(version) == F.lit(highest))


def migrate(source: DataFrame, target: FeatureStore, text_ts: str | None = None) -> DataFrame:
    """Copy a table into a store and return the statistics of the result."""
    rows = utc_normalise(source, text_ts) if text_ts else source
    target.init().save(rows)
    return table_stats(target.read())


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path
