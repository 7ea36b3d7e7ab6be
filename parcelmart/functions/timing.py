"""Lateness and duration of one order, as column expressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS = T.DecimalType(10, 3)


def days_between(start: str, end: str) -> Column:
    """Days from ``start`` to ``end`` as decimal(10,3), rounded half up.

    The difference of two zone-free timestamps is an interval, so no session time zone takes part.
    """
    gap = F.col(end) - F.col(start)
    seconds = (
        F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600
        + F.extract(F.lit("MINUTE"), gap) * 60
    )
    exact = seconds.cast(T.DecimalType(18, 0)) + F.extract(F.lit("SECOND"), gap)
    return (exact / F.lit(86400)).cast(DAYS)


def late_flag() -> Column:
    """TRUE / FALSE, and NULL while either of the two dates is unknown."""
    return F.col("delivered_at") > F.col("estimated_at")


def late_days() -> Column:
    """Days after the estimate; 0 (not NULL) for orders on time and for unknown dates."""
    return F.when(late_flag(), days_between("estimated_at", "delivered_at")).otherwise(F.lit(0).cast(DAYS))


def delivery_days() -> Column:
    return days_between("purchased_at", "delivered_at")


def month_of(column: str) -> Column:
    """First day of the month as a date; free of any session time zone."""
    return F.trunc(F.col(column).cast("date"), "month")


def purchased_within(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows purchased from ``start`` to ``end``, both days included.

    A mart written by ``plans.warehouse`` is partitioned by purchase month; then the month bounds are
    stated as well, so that whole partitions are skipped.
    """
    kept = df.filter(
        (F.col("purchased_at") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("purchased_at") < F.lit(end + timedelta(days=1)).cast("timestamp_ntz"))
    )
    if "purchase_month" in df.columns:
        kept = kept.filter(F.col("purchase_month").between(F.lit(start.replace(day=1)), F.lit(end)))
    return kept
