"""Joins that stay balanced when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """``big`` joined to ``small`` on ``keys``, each key spread over ``salts`` tasks.

    Rows of ``big`` draw their salt from ``spread_by``; rows of ``small`` (few per key) are repeated for
    each salt. For joins whose keys are few or lopsided and whose result is grouped again, where
    adaptive execution cannot split a partition. ``how`` is inner, left or left_anti.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
