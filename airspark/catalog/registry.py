"""Collects the named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


# Sums of doubles differ in the last bits between engines; the nudge keeps such
# a difference from deciding which way a half is rounded.
NUDGE = 1e-9


def r6(value) -> Column:
    """Six decimals."""
    return F.round((value if isinstance(value, Column) else F.col(value)) + F.lit(NUDGE), 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def q6(expr: str) -> str:
    """The SQL form of ``r6``; adding zero removes a negative zero."""
    return f"(round({expr} + {NUDGE}::double, 6) + 0.0)"
