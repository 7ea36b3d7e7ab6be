"""Jobs of the staging, mart, metric and quality layers."""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession


from parcelmart.functions.numbers import decimals_to_double
from parcelmart.operators import marts as build
from parcelmart.operators import metrics, quality, staging
from parcelmart.operators.keys import DuplicateKeyError, assert_unique
from parcelmart.plans.warehouse import MART_KEYS, Marts, layer_row_counts, marts_from_staging, refresh_marts
from parcelmart.session import shared_folder
from parcelmart.sources import testdata as td

START, END = date(1997 + 20, 1, 1), date(1998 + 20, 12, 31)


def marts(spark: SparkSession, folder: str) -> Marts:
    return marts_from_staging(td.staging(spark, folder))


_stored: dict[tuple[str, str], Marts] = {}


def stored_marts(spark: SparkSession, folder: str) -> Marts:
    """The marts of a test folder as written tables, refreshed once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        name = hashlib.sha256(folder.encode()).hexdigest()[:12]
        _stored[key] = refresh_marts(spark, td.staging(spark, folder), shared_folder(spark, f"marts-{name}"))
    return _stored[key]


def _staging_jobs() -> dict:
    return {
        "stg_orders": lambda s, f: staging.stg_orders(td.raw_orders(s, f)),
        "stg_order_items": lambda s, f: staging.stg_order_items(td.raw_order_items(s, f)),
        "stg_order_payments": lambda s, f: staging.stg_order_payments(td.raw_order_payments(s, f)),
        "stg_reviews": lambda s, f: staging.stg_reviews(td.raw_order_reviews(s, f)),
        "stg_products": lambda s, f: staging.stg_products(td.raw_products(s, f), td.x_translation(s, f)),
        "stg_customers": lambda s, f: staging.stg_customers(td.raw_customers(s, f)),
        "stg_sellers": lambda s, f: staging.stg_sellers(td.raw_sellers(s, f)),
    }


def _mart_jobs() -> dict:
    jobs = {
        "order_item_agg": lambda s, f: build.order_item_agg(td.x_items(s, f)),
        "order_payment_agg": lambda s, f: build.order_payment_agg(td.x_payments(s, f)),
        "order_review_agg": lambda s, f: build.order_review_agg(td.x_reviews(s, f)),
        "order_timing": lambda s, f: build.order_timing(td.x_orders(s, f)).select(
            "order_id", "is_late", "late_days", "delivery_days"
        ),
    }
    for column in ("is_late", "late_days", "delivery_days"):
        name = "late_flag" if column == "is_late" else column
        jobs[name] = lambda s, f, c=column: build.order_timing(td.x_orders(s, f)).select("order_id", c)
    names = {
        "mart_order_fulfillment": "orders",
        "mart_seller_order_fulfillment": "seller_orders",
        "mart_category_order_fulfillment": "category_orders",
        "mart_review_analysis_base": "reviews",
        "mart_payment_analysis_base": "payments",
        "mart_seller_performance_monthly": "seller_monthly",
        "mart_category_performance_monthly": "category_monthly",
    }
    for name, attribute in names.items():
        jobs[name] = lambda s, f, a=attribute: getattr(marts(s, f), a)
    return jobs


def metric_calls() -> dict:
    """Name -> call on marts. Shared by the registered jobs and the bench."""
    m = metrics
    return {
        "sales_summary": lambda x: m.sales_summary(x, START, END),
        "operations_overview": lambda x: m.operations_overview(x, START, END),
        "monthly_trend": lambda x: m.monthly_trend(x, START, END),
        "geography_performance": lambda x: m.geography_performance(x, START, END, 20, 100),
        "freight_analysis_overall": lambda x: m.freight_analysis(x, START, END, "overall", 1, 100),
        "freight_analysis_state": lambda x: m.freight_analysis(x, START, END, "customer_state", 20, 100),
        "freight_analysis_category": lambda x: m.freight_analysis(x, START, END, "category", 20, 100),
        "payment_analysis": lambda x: m.payment_analysis(x, START, END, 20),
        "delivery_performance_overall": lambda x: m.delivery_performance(x, START, END, "overall", 1, 100),
        "delivery_performance_seller": lambda x: m.delivery_performance(x, START, END, "seller_id", 20, 100),
        "delivery_performance_category": lambda x: m.delivery_performance(x, START, END, "category", 20, 100),
        "late_vs_on_time_reviews": lambda x: m.late_vs_on_time_reviews(x, START, END),
        "seller_diagnostic": lambda x: m.seller_diagnostic(x, START, END, 34),
        "review_samples": lambda x: m.review_samples(x, START, END, 2, 100),
        "review_samples_late": lambda x: m.review_samples(x, START, END, 2, 100, True),
        "review_samples_on_time": lambda x: m.review_samples(x, START, END, 2, 100, False),
    }


SUMMARIES = (
    "sales_summary", "operations_overview", "monthly_trend", "geography_performance",
    "freight_analysis_overall", "freight_analysis_category", "payment_analysis",
    "delivery_performance_overall", "late_vs_on_time_reviews", "seller_diagnostic", "review_samples",
)


def _metric_jobs() -> dict:
    jobs = {
        "data_freshness": lambda s, f: metrics.data_freshness(marts(s, f)),
        "seller_diagnostic_all": lambda s, f: metrics.seller_diagnostic_all(marts(s, f), START, END),
    }
    for name, call in metric_calls().items():
        jobs[name] = lambda s, f, c=call: c(marts(s, f)).rows
        if name in SUMMARIES:
            jobs[f"{name}_summary"] = lambda s, f, c=call: c(marts(s, f)).summary
    return jobs


def unique_marts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each mart passes its check of unique keys; and the order mart again with planted repeats."""
    stored, out = stored_marts(spark, folder), []

    def passes(df: DataFrame, keys: list[str], name: str) -> bool:
        try:
            assert_unique(df, keys, name)
        except DuplicateKeyError:
            return False
        return True

    for attribute, (name, keys) in MART_KEYS.items():
        if keys:
            out.append((name, passes(getattr(stored, attribute), keys, name)))
    orders, keys = stored.orders, MART_KEYS["orders"][1]
    planted = orders.unionByName(orders.where("CAST(order_id AS BIGINT) % 500 = 0"))
    out.append(("planted", passes(planted, keys, "planted")))
    return spark.createDataFrame(out, "mart string, is_unique boolean")


def _quality_jobs() -> dict:
    q = quality
    return {
        "assert_unique": unique_marts,
        "dq_row_counts": lambda s, f: q.dq_row_counts(td.raw_tables(s, f)),
        "dq_key_integrity": lambda s, f: q.dq_key_integrity(td.raw_tables(s, f)),
        "dq_time_quality": lambda s, f: q.dq_time_quality(staging.stg_orders(td.raw_orders(s, f))),
        "dq_missingness": lambda s, f: q.dq_missingness(td.raw_tables(s, f)),
        "dq_aggregation_risk": lambda s, f: q.dq_aggregation_risk(td.raw_tables(s, f)),
        "dq_report": lambda s, f: q.dq_report(td.raw_tables(s, f), staging.stg_orders(td.raw_orders(s, f))),
        "layer_row_counts": lambda s, f: layer_row_counts(td.raw_tables(s, f), stored_marts(s, f), td.x_orders(s, f)),
    }


def jobs() -> dict:
    out = {**_staging_jobs(), **_mart_jobs(), **_metric_jobs(), **_quality_jobs()}
    return {name: _as_rows(job) for name, job in out.items()}


def _as_rows(job):
    return lambda spark, folder: decimals_to_double(job(spark, folder))
