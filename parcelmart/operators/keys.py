"""Uniqueness of the mart grains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A mart holds two rows for one key of its grain."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def assert_unique(df: DataFrame, keys: list[str], name: str = "mart") -> None:
    found = duplicate_keys(df, keys).take(1)
    if found:
        raise DuplicateKeyError(f"{name} is not unique on {', '.join(keys)}: {found[0].asDict()}")
