"""Training sets: targets, complete rows, feature choice, scaling and splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from airspark.operators.features import full_features
from airspark.operators.quality import complete_rows
from airspark.operators.series import numbered
from airspark.schema import FEATURES, OPTIONAL_FEATURE, STATION, TS
from airspark.session import written

TRAIN_SHARE = 0.8
FOLDS = 3


def feature_select(df: DataFrame) -> list[str]:
    """The model inputs present in ``df``, in their fixed order.

    The change rate counts only if any row has one.
    """
    names = [f for f in FEATURES if f in df.columns]
    if OPTIONAL_FEATURE in df.columns and not df.where(F.col(OPTIONAL_FEATURE).isNotNull()).isEmpty():
        names.append(OPTIONAL_FEATURE)
    return names


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation of each feature: a few numbers, held by the driver."""

    mean: dict[str, float]
    std: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, features: list[str]) -> "Scaler":
        # Equal extremes tell a constant: merged partial sums may leave it a tiny deviation.
        same = {c: F.min(c) == F.max(c) for c in features}
        row = df.agg(
            *[F.when(same[c], F.min(c)).otherwise(F.avg(c)).cast("double").alias(f"m_{c}") for c in features],
            *[F.when(same[c], 0.0).otherwise(F.stddev_pop(c)).alias(f"s_{c}") for c in features],
        ).first()
        return Scaler({c: row[f"m_{c}"] for c in features}, {c: row[f"s_{c}"] or 0.0 for c in features})

    def only(self, names: list[str]) -> "Scaler":
        return Scaler({n: self.mean[n] for n in names}, {n: self.std[n] for n in names})

    def divisor(self, feature: str) -> float:
        """A constant feature is only centred."""
        return self.std[feature] or 1.0

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - F.lit(m)) / F.lit(self.divisor(c)) for c, m in self.mean.items() if m is not None}
        )


def labelled(df: DataFrame, strategy: str = "recursive", subset: list[str] | None = None, **how) -> DataFrame:
    """Feature rows with their target and no missing value.

    ``subset`` limits which columns must be present; the default is all.
    """
    return complete_rows(full_features(df, target=strategy, **how), subset)


def scaled_set(rows: DataFrame, fit_on: str = "all") -> tuple[DataFrame, list[str], Scaler]:
    """Scaled inputs with target, the input names, and the scaler, from labelled rows.

    ``fit_on="train"`` fits the scaler on the training part only.
    """
    basis = chrono_split(rows).where("is_train") if fit_on == "train" else rows
    # One pass finds the scale of every candidate and whether the optional one has values.
    candidates = [f for f in [*FEATURES, OPTIONAL_FEATURE] if f in rows.columns]
    scaler = Scaler.fit(basis, candidates)
    names = [f for f in candidates if f != OPTIONAL_FEATURE or scaler.mean[f] is not None]
    scaler = scaler.only(names)
    marks = [c for c in ("is_train", "is_tuning") if c in rows.columns]
    return scaler.transform(rows.select(STATION, TS, *names, "target", *marks)), names, scaler


def training_set(df: DataFrame, strategy: str = "recursive", fit_on: str = "all", **how) -> tuple[DataFrame, list[str], Scaler]:
    """``scaled_set`` of observations. The labelled rows are written once and read by each pass."""
    return scaled_set(written(labelled(df, strategy, **how), "labelled"), fit_on)


def chrono_split(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Mark the first part of each series for training, and the same part of that for tuning."""
    split = numbered(df)
    train = F.floor(F.lit(share) * F.col("rn_total"))
    return split.withColumns(
        {"is_train": F.col("rn") <= train, "is_tuning": F.col("rn") <= F.floor(F.lit(share) * train)}
    )


def contiguous_folds(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Number ``fold`` from 0: equal consecutive parts of each series."""
    part = (F.col("rn") - 1) * folds
    return numbered(df).withColumn("fold", ((part - F.pmod(part, "rn_total")) / F.col("rn_total")).cast("int"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: tuple[str, ...] = (STATION, TS)) -> DataFrame:
    """``n`` rows without replacement; the same rows on every run.

    The rows with the smallest hashes. A count tells below which hash ``n`` rows lie for
    all but certain (ten standard deviations), so little more than ``n`` rows are sorted.
    """
    total = df.count()
    share = min(1.0, (n + 10 * n**0.5 + 10) / max(total, 1))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    # The first 13 hex digits are 52 bits.
    hashed = df.withColumn("_h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"))
    return hashed.where(F.col("_h") <= F.lit(int(share * (1 << 52)))).orderBy("_h", *key).limit(n).drop("_h")
