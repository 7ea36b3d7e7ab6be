"""Exact decimal ratios and averages, rounded once and half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column, precision: int, scale: int) -> Column:
    """numerator / denominator as decimal(precision, scale); NULL for a zero denominator.

    The numerator is a decimal. The division itself keeps far more digits than the result, so
    the cast is the only rounding (Spark's own ``avg(decimal)`` rounds a first time at scale + 4).
    """
    return (numerator / F.nullif(denominator, F.lit(0))).cast(T.DecimalType(precision, scale))


def count_ratio(numerator: str, denominator: str, precision: int = 10, scale: int = 5) -> Column:
    """Ratio of two long columns."""
    return ratio(F.col(numerator).cast(T.DecimalType(20, 0)), F.col(denominator), precision, scale)


def mean(total: str, count: str, precision: int, scale: int) -> Column:
    """Average from an additive (sum, count) pair."""
    return ratio(F.col(total), F.col(count), precision, scale)


def money(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast(T.DecimalType(16, 2))


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Result rows carry plain doubles instead of decimals."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ])
