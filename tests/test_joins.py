from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parcelmart.operators.joins import salted_join


@pytest.fixture(scope="module")
def lopsided(spark):
    """Ten thousand rows, a third of them with one key, and some without a key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 100)
    return spark.range(10_000).withColumn("k", key.cast("bigint"))


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_equals_plain_join(spark, lopsided, how):
    small = spark.range(0, 60).select(F.col("id").alias("k"), *([] if how == "left_anti" else [(F.col("id") * 2).alias("v")]))
    plain = lopsided.join(small, "k", how)
    salted = salted_join(lopsided, small, ["k"], ["id"], how).select(*plain.columns)
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
