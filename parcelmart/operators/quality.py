"""Data-quality checks: 24 checks in five suites, one row per check.

Input is the RAW layer (all text) plus typed orders for the time checks. Checks over one table share one
pass. Orphans are counted per key before the anti join, so a key that owns many rows travels once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECKED_TABLES = {
    "orders": "orders", "order_items": "order_items", "reviews": "order_reviews", "customers": "customers",
    "products": "products", "sellers": "sellers",
}
UNIQUE_KEYS = {
    "duplicate_order_ids": ("orders", "order_id"),
    "duplicate_customer_ids": ("customers", "customer_id"),
    "duplicate_product_ids": ("products", "product_id"),
    "duplicate_seller_ids": ("sellers", "seller_id"),
    "duplicate_review_ids": ("order_reviews", "review_id"),
}
ORPHANS = {
    "orphan_order_items": ("order_items", "orders", "order_id"),
    "orphan_reviews": ("order_reviews", "orders", "order_id"),
    "orphan_customer_orders": ("orders", "customers", "customer_id"),
}


def _one(df: DataFrame, checks: dict[str, Column], total: bool = False) -> DataFrame:
    """One pass over ``df``; the checks become rows (check_name, value, total)."""
    names = list(checks)
    row = df.agg(*[c.cast("bigint").alias(n) for n, c in checks.items()], F.count(F.lit(1)).alias("row_count"))
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("value")) for n in names])
    of = F.col("row_count") if total else F.lit(None).cast("bigint")
    return row.select(F.inline(pairs), of.alias("total"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dq_row_counts(raw: dict[str, DataFrame]) -> DataFrame:
    counts = [_one(raw[t], {name: F.count(F.lit(1))}) for name, t in CHECKED_TABLES.items()]
    return _union(counts).select(F.col("check_name").alias("table_name"), "value")


def dq_key_integrity(raw: dict[str, DataFrame]) -> DataFrame:
    repeats = [
        _one(raw[t], {name: F.count(F.lit(1)) - F.count_distinct(F.col(key))})
        for name, (t, key) in UNIQUE_KEYS.items()
    ]
    orphans = []
    for name, (child, parent, key) in ORPHANS.items():
        per_key = raw[child].groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        lost = per_key.join(raw[parent].select(key), key, "left_anti")
        orphans.append(_one(lost, {name: F.coalesce(F.sum("n"), F.lit(0))}))
    return _union(repeats + orphans).select("check_name", "value")


def dq_time_quality(orders: DataFrame) -> DataFrame:
    ended_early = F.col("order_status").isin("canceled", "unavailable")
    return _one(orders, {
        "approved_before_purchase": F.count_if(F.col("approved_at") < F.col("purchased_at")),
        "delivered_before_carrier": F.count_if(F.col("delivered_at") < F.col("carrier_at")),
        "cancelled_with_delivery_date": F.count_if(ended_early & F.col("delivered_at").isNotNull()),
        "delivered_missing_actual_date": F.count_if(
            (F.col("order_status") == "delivered") & F.col("delivered_at").isNull()
        ),
    }).select("check_name", "value")


def _missing(column: str) -> Column:
    return F.count_if(F.col(column).isNull() | (F.col(column) == ""))


def dq_missingness(raw: dict[str, DataFrame]) -> DataFrame:
    products = _one(raw["products"], {
        "product_category_missing": _missing("product_category_name"),
        "product_weight_missing": _missing("product_weight_g"),
    }, total=True)
    reviews = _one(
        raw["order_reviews"], {"review_message_missing": _missing("review_comment_message")}, total=True
    )
    return products.unionByName(reviews).select("check_name", F.col("value").alias("missing"), "total")


def dq_aggregation_risk(raw: dict[str, DataFrame]) -> DataFrame:
    """Orders whose several items, sellers or payments would multiply in a careless join."""
    money = "decimal(24,2)"
    per_seller = raw["order_items"].groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("price").cast(money) + F.col("freight_value").cast(money)).cast(money).alias("billed"),
    )
    per_order = per_seller.groupBy("order_id").agg(
        F.sum("n").alias("items"), F.count("seller_id").alias("sellers"),
        F.sum("billed").cast(money).alias("billed"),
    )
    paid = raw["order_payments"].groupBy("order_id").agg(
        F.sum(F.col("payment_value").cast(money)).cast(money).alias("paid")
    )
    sums = raw["orders"].select("order_id").join(paid, "order_id", "left").join(
        per_order.select("order_id", "billed"), "order_id", "left"
    )
    gap = F.abs(F.coalesce("paid", F.lit(0)) - F.coalesce("billed", F.lit(0)))
    return _one(per_order, {
        "multi_item_orders": F.count_if(F.col("items") > 1),
        "multi_seller_orders": F.count_if(F.col("sellers") > 1),
    }).unionByName(
        _one(sums, {"payment_vs_items_abs_diff_over_1": F.count_if(gap > 1)})
    ).select("check_name", "value")


def dq_report(raw: dict[str, DataFrame], orders: DataFrame) -> DataFrame:
    """All suites as one table (suite, check_name, value, total)."""
    none = F.lit(None).cast("bigint")
    suites = {
        "row_counts": dq_row_counts(raw).select(F.col("table_name").alias("check_name"), "value", none.alias("total")),
        "key_integrity": dq_key_integrity(raw).withColumn("total", none),
        "time_quality": dq_time_quality(orders).withColumn("total", none),
        "missingness": dq_missingness(raw).select("check_name", F.col("missing").alias("value"), "total"),
        "aggregation_risk": dq_aggregation_risk(raw).withColumn("total", none),
    }
    return _union([
        df.select(F.lit(name).alias("suite"), "check_name", "value", "total") for name, df in suites.items()
    ])
