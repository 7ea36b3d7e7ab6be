"""STAGING: typed views over the all-text RAW tables.

Empty text is NULL; any other text that does not cast is an error (ANSI casts), never a silent NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
DIMENSION = "decimal(18,6)"


@dataclass(frozen=True)
class Staging:
    """The seven typed staging frames."""

    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    customers: DataFrame
    sellers: DataFrame


def _typed(source: str, target: str, dtype: str) -> Column:
    return F.nullif(F.col(source), F.lit("")).cast(dtype).alias(target)


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        _typed("order_status", "order_status", "string"),
        _typed("order_purchase_timestamp", "purchased_at", "timestamp_ntz"),
        _typed("order_approved_at", "approved_at", "timestamp_ntz"),
        _typed("order_delivered_carrier_date", "carrier_at", "timestamp_ntz"),
        _typed("order_delivered_customer_date", "delivered_at", "timestamp_ntz"),
        _typed("order_estimated_delivery_date", "estimated_at", "timestamp_ntz"),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        _typed("order_item_id", "order_item_id", "int"),
        "product_id",
        "seller_id",
        _typed("shipping_limit_date", "shipping_limit_at", "timestamp_ntz"),
        _typed("price", "price", MONEY),
        _typed("freight_value", "freight_value", MONEY),
    )


def stg_order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        _typed("payment_sequential", "payment_sequential", "int"),
        _typed("payment_type", "payment_type", "string"),
        _typed("payment_installments", "payment_installments", "int"),
        _typed("payment_value", "payment_value", MONEY),
    )


def stg_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        "review_id",
        "order_id",
        _typed("review_score", "review_score", "int"),
        _typed("review_comment_title", "review_comment_title", "string"),
        _typed("review_comment_message", "review_comment_message", "string"),
        _typed("review_creation_date", "review_created_at", "timestamp_ntz"),
        _typed("review_answer_timestamp", "review_answered_at", "timestamp_ntz"),
    )


def stg_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    """Category in English where a translation exists, else the source name, else 'unknown'.

    The translation is joined without a hint: Spark broadcasts it while its size is below the
    configured threshold and shuffles it otherwise.
    """
    english = translation.select("product_category_name", "product_category_name_english")
    return raw.join(english, "product_category_name", "left").select(
        "product_id",
        "product_category_name",
        F.coalesce("product_category_name_english", "product_category_name", F.lit("unknown")).alias("category"),
        _typed("product_name_lenght", "product_name_length", "int"),
        _typed("product_description_lenght", "product_description_length", "int"),
        _typed("product_photos_qty", "product_photos_qty", "int"),
        _typed("product_weight_g", "product_weight_g", DIMENSION),
        _typed("product_length_cm", "product_length_cm", DIMENSION),
        _typed("product_height_cm", "product_height_cm", DIMENSION),
        _typed("product_width_cm", "product_width_cm", DIMENSION),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "customer_unique_id",
        _typed("customer_zip_code_prefix", "zip_prefix", "int"),
        "customer_city",
        "customer_state",
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "seller_id",
        _typed("seller_zip_code_prefix", "zip_prefix", "int"),
        "seller_city",
        "seller_state",
    )
