"""Named jobs over a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


def all_jobs() -> dict[str, Job]:
    from parcelmart.registry import knowledge, requests, sources, warehouse

    return {**warehouse.jobs(), **knowledge.jobs(), **requests.jobs(), **sources.jobs()}
