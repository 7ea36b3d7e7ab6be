"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from parcelmart.session import shared_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once and read back: used several times, it is computed once, and survives lost executors."""
    path = shared_folder(df.sparkSession, f"{purpose}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
