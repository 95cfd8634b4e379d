"""Scalar column expressions.  NULL is the only missing value: none of these lets a
NaN or an infinity through."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SD_FLOOR = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """``c``, or NULL where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` with NULL for a zero denominator or a non-finite result."""
    return finite(F.try_divide(col(a), col(b)))


def sd_ratio(a: Column, sd: Column) -> Column:
    """``a / sd``, NULL when the spread is numerically zero."""
    return finite(F.when(sd > F.lit(SD_FLOOR), a / sd))


def floor_at(c: Column | str, bound: float) -> Column:
    """``max(c, bound)`` that keeps NULL (bare ``greatest`` would return the bound)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(bound)))


def positive_ln(c: Column | str) -> Column:
    """Natural log; zero, negative and NULL all give NULL."""
    c = col(c)
    return F.when(c > 0, F.ln(c))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column, for comparable output."""
    return df.select(
        *[
            F.round(finite(F.col(f.name)), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def is_date_keyed(df: DataFrame, on: str = "date") -> bool:
    return isinstance(df.schema[on].dataType, T.DateType)


def by_date(df: DataFrame, on: str = "date") -> DataFrame:
    """Broadcast hint for a table holding one row per calendar day.

    DATE keys bound such a table to a few tens of thousands of narrow rows, so the hint
    is safe at any panel size.  With any other key type the planner decides.
    """
    return F.broadcast(df) if is_date_keyed(df, on) else df
