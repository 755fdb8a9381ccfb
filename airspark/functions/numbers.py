"""Null-safe arithmetic used by the other column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def clean(value: Column) -> Column:
    """NaN and infinities become NULL: the tables only know NULL as missing."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def coerce(value: Column) -> Column:
    """Text or number to double; what does not parse is NULL."""
    return clean(value.try_cast("double"))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL instead of failing on a zero denominator."""
    return F.try_divide(top, bottom)


def mean_present(*values: Column) -> Column:
    """Row-wise mean over the values that are present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    count = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return ratio(total, count)
