"""RAW -> STAGING -> MART as batch jobs over Parquet, and the marts as one object."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmart.functions.timing import month_of
from parcelmart.operators import marts as build
from parcelmart.operators import staging as stage
from parcelmart.operators.keys import assert_unique
from parcelmart.operators.staging import Staging
from parcelmart.schemas import RAW_COLUMNS


@dataclass(frozen=True)
class Marts:
    orders: DataFrame
    seller_orders: DataFrame
    category_orders: DataFrame
    reviews: DataFrame
    payments: DataFrame
    seller_monthly: DataFrame
    category_monthly: DataFrame


# Folder and unique key of each mart (None: repeated keys are allowed).
MART_KEYS: dict[str, tuple[str, list[str] | None]] = {
    "orders": ("mart_order_fulfillment", ["order_id"]),
    "seller_orders": ("mart_seller_order_fulfillment", ["order_id", "seller_id"]),
    "category_orders": ("mart_category_order_fulfillment", ["order_id", "category"]),
    "reviews": ("mart_review_analysis_base", None),
    "payments": ("mart_payment_analysis_base", ["order_id", "payment_type"]),
    "seller_monthly": ("mart_seller_performance_monthly", ["month", "seller_id"]),
    "category_monthly": ("mart_category_performance_monthly", ["month", "category"]),
}


def marts_from_staging(stg: Staging) -> Marts:
    """All marts as lazy plans. A query over one of them runs only the branches it reads."""
    orders = build.mart_order_fulfillment(stg.orders, stg.customers, stg.items, stg.payments, stg.reviews)
    core = build.order_core(stg.orders, stg.reviews)
    sellers = build.mart_seller_order_fulfillment(stg.items, core, stg.sellers)
    categories = build.mart_category_order_fulfillment(stg.items, stg.products, core)
    return Marts(
        orders=orders,
        seller_orders=sellers,
        category_orders=categories,
        reviews=build.mart_review_analysis_base(stg.reviews, build.order_timing(stg.orders)),
        payments=build.mart_payment_analysis_base(stg.payments, orders),
        seller_monthly=build.mart_seller_performance_monthly(sellers),
        category_monthly=build.mart_category_performance_monthly(categories),
    )


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/raw/{name}") for name in RAW_COLUMNS}


def staging_from_raw(raw: dict[str, DataFrame]) -> Staging:
    return Staging(
        orders=stage.stg_orders(raw["orders"]),
        items=stage.stg_order_items(raw["order_items"]),
        payments=stage.stg_order_payments(raw["order_payments"]),
        reviews=stage.stg_reviews(raw["order_reviews"]),
        products=stage.stg_products(raw["products"], raw["category_translation"]),
        customers=stage.stg_customers(raw["customers"]),
        sellers=stage.stg_sellers(raw["sellers"]),
    )


VERSION_LOG = "version string, refreshed_at timestamp, mart string, columns string"


# A bucket of orders holds some 2,000,000 items or payments; small tables get up to 8 buckets, so that all cores work.
ROWS_A_BUCKET = 2_000_000
ROWS_A_SMALL_BUCKET, SMALL_BUCKETS = 200_000, 8


def order_buckets(stg: Staging) -> int:
    rows = max(stg.items.count(), stg.payments.count())
    return max(1, rows // ROWS_A_BUCKET, min(SMALL_BUCKETS, rows // ROWS_A_SMALL_BUCKET))


def _bucketed(df: DataFrame, table: str, path: str, buckets: int, by_month: bool = False) -> DataFrame:
    """``df`` written to ``path`` as a table in buckets of order_id: joins and groups by order read it without a shuffle.

    With ``by_month`` there is one folder per purchase month, and a file for each bucket in it.
    """
    writer = df.withColumn("purchase_month", month_of("purchased_at")).write.partitionBy("purchase_month") if by_month else df.write
    writer.bucketBy(buckets, "order_id").sortBy("order_id").option("path", path).option("compression", "zstd").saveAsTable(table)
    return df.sparkSession.table(table)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back with its own schema, so that it may be empty."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_marts(spark: SparkSession, folder: str) -> Marts:
    """The marts of the last refresh that passed its checks."""
    log = spark.read.schema(VERSION_LOG).parquet(f"{folder}/mart_log")
    last = log.orderBy(F.desc("refreshed_at"), F.desc("version")).limit(len(MART_KEYS)).collect()
    schemas = {r["mart"]: T.StructType.fromJson(json.loads(r["columns"])) for r in last}
    base = f"{folder}/mart/{last[0]['version']}"
    return Marts(**{
        name: spark.read.schema(schemas[mart]).parquet(f"{base}/{mart}") for name, (mart, _) in MART_KEYS.items()
    })


def refresh_marts(spark: SparkSession, stg: Staging, folder: str, buckets: int | None = None) -> Marts:
    """Rebuild every mart under ``folder`` in dependency order and check the unique keys.

    A refresh writes a folder of its own, ``mart/<version>``, and appends to ``mart_log`` once all checks have passed.
    Readers take the last version of the log, so a refresh that fails leaves the marts as they were. Folders of
    earlier versions stay until they are removed by hand.

    Items, payments and reviews are dealt by order_id once, each written as a table in buckets (``dealt/<version>``), and the
    marts at order grain have the same buckets. So facts meet, marts join the order mart, and keys are checked without another
    shuffle, and a lost executor costs a re-read and not a re-computation. Sellers and products are written too: Spark then
    knows their true size when it decides on a broadcast.
    """
    version = uuid.uuid4().hex
    buckets = buckets or order_buckets(stg)
    made: dict[str, DataFrame] = {}

    def deal(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder}/dealt/{version}/{name}"
        return _bucketed(df.repartition(buckets, "order_id"), f"dealt_{name}_{version}", path, buckets)

    def store(name: str, df: DataFrame, by_month: bool = False) -> DataFrame:
        mart, keys = MART_KEYS[name]
        path = f"{folder}/mart/{version}/{mart}"
        made[name] = _bucketed(df, f"{mart}_{version}", path, buckets, by_month) if by_month else _stored(df, path)
        if keys:
            assert_unique(made[name], keys, mart)
        return made[name]

    items = deal("items", stg.items.drop("order_item_id"))
    payments = deal("payments", stg.payments.drop("payment_sequential"))
    reviews = deal("reviews", stg.reviews.drop("review_answered_at"))
    places = _stored(stg.sellers.select("seller_id", "seller_city", "seller_state"), f"{folder}/dealt/{version}/sellers")
    products = _stored(stg.products.select("product_id", "category"), f"{folder}/dealt/{version}/products")
    people = build.orders_with_customers(stg.orders, stg.customers).repartition(buckets, "order_id")
    orders = store("orders", build.order_facts(people, items, payments, reviews), True)
    sellers = store("seller_orders", build.mart_seller_order_fulfillment(items, orders, places), True)
    categories = store("category_orders", build.mart_category_order_fulfillment(items, products, orders), True)
    store("reviews", build.mart_review_analysis_base(reviews, orders), True)
    store("payments", build.mart_payment_analysis_base(payments, orders), True)
    store("seller_monthly", build.mart_seller_performance_monthly(sellers))
    store("category_monthly", build.mart_category_performance_monthly(categories))
    log = [(version, MART_KEYS[name][0], json.dumps(df.schema.jsonValue())) for name, df in made.items()]
    spark.createDataFrame(log, "version string, mart string, columns string").select(
        "version", F.current_timestamp().alias("refreshed_at"), "mart", "columns",
    ).coalesce(1).write.mode("append").parquet(f"{folder}/mart_log")
    return Marts(**made)


def layer_row_counts(raw: dict[str, DataFrame], marts: Marts, orders: DataFrame) -> DataFrame:
    """Rows of each RAW table and mart, plus first and last purchase day, as one small table."""
    counts = [_count("raw", name, df) for name, df in raw.items()]
    counts += [_count("mart", mart, getattr(marts, name)) for name, (mart, _) in MART_KEYS.items()]
    days = orders.agg(F.min("purchased_at").cast("date").alias("a"), F.max("purchased_at").cast("date").alias("b"))
    span = days.select(
        F.lit("date_range").alias("layer"), F.lit("purchased_at").alias("table_name"),
        F.lit(None).cast("bigint").alias("row_count"), F.col("a").alias("start_date"), F.col("b").alias("end_date"),
    )
    out = span
    for part in counts:
        out = out.unionByName(part)
    return out


def _count(layer: str, name: str, df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("date")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(layer).alias("layer"), F.lit(name).alias("table_name"), "row_count",
        none.alias("start_date"), none.alias("end_date"),
    )
