"""MART layer: one builder per grain.

Facts are always aggregated to the order before they meet, so several items, sellers, payments or
reviews of one order never multiply each other. The aggregations combine on the map side, which also
takes the weight off an order, seller or product that owns a large part of the rows. Dimension joins
carry no broadcast hint: their size grows with the data, so Spark decides by its size threshold, and a
skewed key of a shuffled join is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmart.functions.numbers import mean
from parcelmart.functions.timing import delivery_days, late_days, late_flag, month_of
from parcelmart.operators import measures

TITLE_SEPARATOR = " | "
MESSAGE_SEPARATOR = "\n---\n"


def seller_items(items: DataFrame) -> DataFrame:
    """Items summed per order and seller; the base of the order and the seller grain."""
    return items.groupBy("order_id", "seller_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("price").alias("item_value"),
        F.sum("freight_value").alias("freight_value"),
        F.min("shipping_limit_at").alias("first_shipping_limit_at"),
        F.max("shipping_limit_at").alias("last_shipping_limit_at"),
    )


def order_item_agg(items: DataFrame) -> DataFrame:
    """Per order: items, sellers, values. Rolled up from order-seller rows, so distinct sellers are a count."""
    return seller_items(items).groupBy("order_id").agg(
        F.sum("item_count").alias("item_count"),
        F.count("seller_id").alias("seller_count"),
        F.sum("item_value").alias("item_value"),
        F.sum("freight_value").alias("freight_value"),
    )


def order_payment_agg(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.max("payment_installments").alias("max_installments"),
    )


def order_review_score(reviews: DataFrame) -> DataFrame:
    """Per order: mean score only. Never touches the review texts."""
    scores = reviews.groupBy("order_id").agg(
        F.sum(F.col("review_score").cast("decimal(10,0)")).alias("score"), F.count("review_score").alias("n")
    )
    return scores.select("order_id", mean("score", "n", 5, 2).alias("review_score"))


def order_review_agg(reviews: DataFrame) -> DataFrame:
    """Per order: mean score, texts joined in time order (unknown time last), first review time."""
    in_time = "WITHIN GROUP (ORDER BY review_created_at ASC NULLS LAST, review_id ASC)"
    message_separator = MESSAGE_SEPARATOR.replace("\n", "\\n")
    joined = reviews.groupBy("order_id").agg(
        F.sum(F.col("review_score").cast("decimal(10,0)")).alias("score"),
        F.count("review_score").alias("n"),
        F.expr(f"listagg(review_comment_title, '{TITLE_SEPARATOR}') {in_time}").alias("review_titles"),
        F.expr(f"listagg(review_comment_message, '{message_separator}') {in_time}").alias("review_messages"),
        F.min("review_created_at").alias("first_review_at"),
    )
    return joined.select(
        "order_id", mean("score", "n", 5, 2).alias("review_score"), "review_titles", "review_messages",
        "first_review_at",
    )


def order_timing(orders: DataFrame) -> DataFrame:
    """Orders with lateness and duration; a projection, no join."""
    return orders.withColumns(
        {"is_late": late_flag(), "late_days": late_days(), "delivery_days": delivery_days()}
    )


def order_core(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """The part of the order mart that the seller and category grains read."""
    return order_timing(orders).join(order_review_score(reviews), "order_id", "left")


def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers come first, while rows are narrow; all that follows is partitioned by order_id."""
    people = customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    return orders.join(people, "customer_id", "left")


def mart_order_fulfillment(
    orders: DataFrame, customers: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame
) -> DataFrame:
    """One row per order."""
    return order_facts(orders_with_customers(orders, customers), items, payments, reviews)


def order_facts(orders: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame) -> DataFrame:
    """The order mart from orders that have their customers. Timing comes last, so its columns are not shuffled."""
    wide = order_timing(
        orders
        .join(order_item_agg(items), "order_id", "left")
        .join(order_payment_agg(payments), "order_id", "left")
        .join(order_review_agg(reviews), "order_id", "left")
    )
    return wide.select(
        "order_id", "customer_id", "customer_unique_id", "customer_city", "customer_state", "order_status",
        "purchased_at", "approved_at", "carrier_at", "delivered_at", "estimated_at", "is_late", "late_days",
        "delivery_days",
        F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
        F.coalesce("seller_count", F.lit(0)).cast("bigint").alias("seller_count"),
        F.coalesce("item_value", F.lit(0)).cast("decimal(14,2)").alias("item_value"),
        F.coalesce("freight_value", F.lit(0)).cast("decimal(14,2)").alias("freight_value"),
        "payment_value", "max_installments", "review_score", "review_titles", "review_messages",
        "first_review_at",
    )


def mart_seller_order_fulfillment(items: DataFrame, order_mart: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row per order and seller. Orders come last, so the rows end up partitioned by order_id."""
    order_columns = order_mart.select(
        "order_id", "order_status", "purchased_at", "delivered_at", "estimated_at", "is_late", "late_days",
        "review_score",
    )
    places = sellers.select("seller_id", "seller_city", "seller_state")
    return (
        seller_items(items)
        .join(places, "seller_id", "left")
        .join(order_columns, "order_id")
        .select(
            "order_id", "seller_id", "seller_city", "seller_state", "order_status", "purchased_at",
            "delivered_at", "estimated_at", "is_late", "late_days", "review_score", "item_count",
            "item_value", "freight_value", "first_shipping_limit_at", "last_shipping_limit_at",
        )
    )


def mart_category_order_fulfillment(items: DataFrame, products: DataFrame, order_mart: DataFrame) -> DataFrame:
    """One row per order and category. Unmatched products become 'unknown' only after grouping."""
    order_columns = order_mart.select(
        "order_id", "order_status", "purchased_at", "delivered_at", "estimated_at", "is_late", "late_days",
        "review_score",
    )
    per_category = (
        items.join(products.select("product_id", "category"), "product_id", "left")
        .groupBy("order_id", "category")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.sum("price").alias("item_value"),
            F.sum("freight_value").alias("freight_value"),
        )
    )
    return per_category.join(order_columns, "order_id").select(
        "order_id", F.coalesce("category", F.lit("unknown")).alias("category"), "order_status", "purchased_at",
        "delivered_at", "estimated_at", "is_late", "late_days", "review_score", "item_count", "item_value",
        "freight_value",
    )


def mart_review_analysis_base(reviews: DataFrame, order_mart: DataFrame) -> DataFrame:
    """One row per source review; repeated review ids stay."""
    order_columns = order_mart.select(
        "order_id", "purchased_at", "order_status", "is_late", "late_days", "delivery_days"
    )
    return reviews.join(order_columns, "order_id").select(
        "review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
        "review_created_at", "purchased_at", "order_status", "is_late", "late_days", "delivery_days",
    )


def mart_payment_analysis_base(payments: DataFrame, order_mart: DataFrame) -> DataFrame:
    """One row per order and payment type."""
    order_columns = order_mart.select(
        "order_id", "purchased_at", "order_status", "customer_state", "item_value", "freight_value",
        "is_late", "review_score",
    )
    per_type = payments.groupBy(
        "order_id", F.coalesce("payment_type", F.lit("unknown")).alias("payment_type")
    ).agg(
        F.sum("payment_value").cast("decimal(14,2)").alias("payment_value"),
        F.max("payment_installments").alias("max_installments"),
        F.count(F.lit(1)).alias("payment_sequence_count"),
    )
    return per_type.join(order_columns, "order_id").select(
        "order_id", "payment_type", "payment_value", "max_installments", "payment_sequence_count",
        "purchased_at", "order_status", "customer_state", "item_value", "freight_value", "is_late",
        "review_score",
    )


MONTHLY_COLUMNS = [
    "order_count", "item_value", "freight_value", "eligible_delivery_count", "late_order_count",
    "late_rate", "avg_late_days", "avg_review_score",
]


def _monthly(order_grain_mart: DataFrame, key: str) -> DataFrame:
    keys = [month_of("purchased_at").alias("month"), F.col(key)]
    sums = measures.summed(order_grain_mart, keys, MONTHLY_COLUMNS)
    rows = sums.select("month", key, *measures.formulas(MONTHLY_COLUMNS))
    return rows.withColumn("late_rate", F.col("late_rate").cast("decimal(8,5)"))


def mart_seller_performance_monthly(seller_mart: DataFrame) -> DataFrame:
    return _monthly(seller_mart, "seller_id")


def mart_category_performance_monthly(category_mart: DataFrame) -> DataFrame:
    return _monthly(category_mart, "category")
