"""CSV folder -> RAW -> STAGING -> MART in one call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from parcelmart.plans.warehouse import Marts, read_raw, refresh_marts, staging_from_raw
from parcelmart.sources.raw_csv import load_raw


def load_and_refresh(spark: SparkSession, csv_folder: str, out: str) -> tuple[dict[str, int], Marts]:
    counts = load_raw(spark, csv_folder, out)
    return counts, refresh_marts(spark, staging_from_raw(read_raw(spark, out)), out)
