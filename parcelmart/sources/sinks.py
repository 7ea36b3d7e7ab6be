"""Appending logs and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "parquet")


def _append_by_day(rows: DataFrame, path: str, time: str) -> None:
    dated = rows.withColumn("day", F.col(time).cast("date"))
    dated.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def write_search_log(log: DataFrame, path: str) -> None:
    """Appends the rows of ``operators.retrieval.search_log``."""
    _append_by_day(log, path, "created_at")


def write_event_log(events: DataFrame, path: str, time: str = "created_at") -> None:
    """Appends events, steps or tool calls, in folders by day."""
    _append_by_day(events, path, time)


def write_metric_report(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Replaces a report table (evaluation, quality checks, metric rows)."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}")
    getattr(rows.write.mode("overwrite"), fmt)(path)
