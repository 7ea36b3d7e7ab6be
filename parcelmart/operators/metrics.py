"""The metric catalogue: ten parameterised queries over the marts.

Each function takes the marts and its parameters and returns a :class:`MetricResult`: a lazy frame of
rows, a lazy one-row summary (value, numerator, denominator, freshness) and metadata. Rows leave as
doubles. Every ORDER BY states NULL order and ends in the group key, so that a limit is repeatable.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmart.functions.numbers import decimals_to_double, ratio
from parcelmart.functions.timing import month_of, purchased_within
from parcelmart.operators import measures

PEER_MINIMUM = 5
EXCERPT_CHARS = 280


class MartSet(Protocol):
    orders: DataFrame
    seller_orders: DataFrame
    category_orders: DataFrame
    reviews: DataFrame
    payments: DataFrame


@dataclass(frozen=True)
class MetricResult:
    metric_name: str
    rows: DataFrame
    summary: DataFrame
    filters: dict[str, Any]
    definition: str
    warnings: list[str] = field(default_factory=list)
    empty_warning: str | None = None

    def envelope(self) -> dict[str, Any]:
        """Runs the metric and returns it as one plain dictionary. A metric's own ``top_k`` or months bound its rows."""
        head = self.summary.first()
        rows = [r.asDict(recursive=True) for r in self.rows.collect()]
        plain = [{k: v.isoformat() if isinstance(v, date) else v for k, v in r.items()} for r in rows]
        fresh = head["data_freshness"] if head else None
        warnings = [self.empty_warning] if self.empty_warning and not rows else list(self.warnings)
        return {
            "metric_name": self.metric_name,
            "value": head["value"] if head else None,
            "numerator": head["numerator"] if head else None,
            "denominator": head["denominator"] if head else None,
            "filters": self.filters,
            "definition": self.definition,
            "rows": plain,
            "data_freshness": fresh.isoformat() if fresh else None,
            "warnings": warnings,
        }


def data_freshness(marts: MartSet) -> DataFrame:
    """Last purchase day of the whole order mart, whatever range a metric asks for.

    Of a written mart only the folder of the last month is read.
    """
    orders = marts.orders
    if "purchase_month" in orders.columns:
        last = orders.agg(F.max("purchase_month").alias("m")).scalar()
        orders = orders.filter(F.col("purchase_month") == last)
    return orders.agg(F.max("purchased_at").cast("date").alias("data_freshness"))


def _summary(
    marts: MartSet, rows: DataFrame, value: Column, numerator: Column | None = None,
    denominator: Column | None = None,
) -> DataFrame:
    nothing = F.max(F.lit(None).cast("bigint"))
    one = rows.agg(
        value.alias("value"),
        (nothing if numerator is None else numerator).alias("numerator"),
        (nothing if denominator is None else denominator).alias("denominator"),
    )
    return one.withColumn("data_freshness", data_freshness(marts).scalar())


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _row_count() -> Column:
    return F.count(F.lit(1))


def _no_value() -> Column:
    return F.max(F.lit(None).cast("double"))


def _filtered(df: DataFrame, start: date, end: date, delivered_only: bool) -> DataFrame:
    kept = purchased_within(df, start, end)
    return kept.filter(F.col("order_status") == measures.DELIVERED) if delivered_only else kept


def _dates(start: date, end: date, **more: Any) -> dict[str, Any]:
    return {"start_date": start.isoformat(), "end_date": end.isoformat(), **more}


def _metric_rows(df: DataFrame, keys: list[Column], names: list[str], columns: list[str]) -> DataFrame:
    return measures.summed(df, keys, columns).select(*names, *measures.formulas(columns))


# --- sales and status ------------------------------------------------------------------------------

SALES_COLUMNS = ["order_count", "gmv_proxy", "avg_order_value", "freight_share", "avg_review_score"]


def sales_summary(marts: MartSet, start: date, end: date) -> MetricResult:
    rows = decimals_to_double(
        _metric_rows(_filtered(marts.orders, start, end, True), [], [], SALES_COLUMNS)
    )
    return MetricResult(
        "sales_summary", rows,
        _summary(marts, rows, F.max("gmv_proxy"), denominator=F.max("order_count")),
        _dates(start, end, order_status="delivered"),
        "value of goods = sum of item prices of delivered orders; averages are per order",
        ["The value of goods is a proxy, not booked revenue."],
    )


OVERVIEW_COLUMNS = ["order_count", "item_value", "freight_value", "avg_review_score"]


def operations_overview(marts: MartSet, start: date, end: date) -> MetricResult:
    status = F.coalesce("order_status", F.lit("unknown")).alias("order_status")
    grouped = _metric_rows(
        _filtered(marts.orders, start, end, False), [status], ["order_status"], OVERVIEW_COLUMNS
    )
    total = F.sum("order_count").over(Window.partitionBy())  # over the few statuses
    share = ratio(F.col("order_count").cast("decimal(20,0)"), total, 10, 5).alias("order_share")
    rows = decimals_to_double(
        grouped.select("order_status", "order_count", share, "item_value", "freight_value", "avg_review_score")
    ).orderBy(F.desc("order_count"), F.asc("order_status"))
    exceptions = F.when(F.col("order_status").isin("canceled", "unavailable"), F.col("order_count"))
    return MetricResult(
        "operations_overview", rows,
        _summary(
            marts, rows, _total("order_count"), F.coalesce(F.sum(exceptions), F.lit(0)), _total("order_count")
        ),
        _dates(start, end),
        "orders per status; canceled and unavailable orders count as exceptions",
        ["A status is the last one recorded in the data, not a live one."],
    )


TREND_COLUMNS = [
    "order_count", "delivered_order_count", "gmv_proxy", "freight_value", "eligible_delivery_count",
    "late_order_count", "late_rate", "avg_delivered_days as avg_delivery_days", "avg_review_score",
]


def monthly_trend(marts: MartSet, start: date, end: date, delivered_only: bool = False) -> MetricResult:
    df = _filtered(marts.orders, start, end, delivered_only)
    rows = decimals_to_double(
        _metric_rows(df, [month_of("purchased_at").alias("month")], ["month"], TREND_COLUMNS)
    ).orderBy("month")
    return MetricResult(
        "monthly_operations_trend", rows,
        _summary(marts, rows, _row_count(), denominator=_total("order_count")),
        _dates(start, end, grain="month", delivered_only=delivered_only),
        "orders per purchase month; the late rate keeps its own denominator",
        ["First and last month may be cut by the range.", "The value of goods is a proxy, not booked revenue."],
    )


# --- place, freight, payment -----------------------------------------------------------------------

GEOGRAPHY_COLUMNS = [
    "order_count", "eligible_delivery_count", "late_order_count", "late_rate", "avg_late_days",
    "avg_delivery_days", "avg_review_score", "gmv_proxy",
]


def _state() -> Column:
    return F.coalesce("customer_state", F.lit("unknown")).alias("customer_state")


def geography_performance(
    marts: MartSet, start: date, end: date, min_orders: int = 20, top_k: int = 27, delivered_only: bool = True
) -> MetricResult:
    df = _filtered(marts.orders, start, end, delivered_only)
    rows = decimals_to_double(
        _metric_rows(df, [_state()], ["customer_state"], GEOGRAPHY_COLUMNS).filter(
            F.col("order_count") >= min_orders
        )
    ).orderBy(F.desc_nulls_last("late_rate"), F.desc("order_count"), F.asc("customer_state")).limit(top_k)
    return MetricResult(
        "customer_state_delivery_performance", rows,
        _summary(marts, rows, _row_count(), denominator=_total("order_count")),
        _dates(start, end, min_orders=min_orders, top_k=top_k, delivered_only=delivered_only),
        "lateness, delivery time, score and value of goods per customer state",
        ["Differences between states describe, they do not explain."],
    )


FREIGHT_COLUMNS = [
    "order_count", "item_value", "freight_value", "freight_share", "avg_freight_per_order",
    "avg_review_score", "late_rate",
]


def freight_analysis(
    marts: MartSet, start: date, end: date, group_by: str = "overall", min_orders: int = 1, top_k: int = 10,
    delivered_only: bool = True,
) -> MetricResult:
    source, key, name = {
        "overall": (marts.orders, F.lit("overall").alias("group_key"), "group_key"),
        "customer_state": (marts.orders, _state(), "customer_state"),
        "category": (marts.category_orders, F.col("category"), "category"),
    }[group_by]
    rows = decimals_to_double(
        _metric_rows(_filtered(source, start, end, delivered_only), [key], [name], FREIGHT_COLUMNS).filter(
            F.col("order_count") >= min_orders
        )
    ).orderBy(F.desc_nulls_last("freight_share"), F.desc("order_count"), F.asc(name)).limit(top_k)
    overall = group_by == "overall"
    return MetricResult(
        "freight_cost_structure", rows,
        _summary(
            marts, rows, F.max("freight_share") if overall else _no_value(),
            denominator=F.max("order_count") if overall else None,
        ),
        _dates(start, end, group_by=group_by, min_orders=min_orders, top_k=top_k, delivered_only=delivered_only),
        "freight share = freight / (goods + freight)",
        ["Freight is what the items carry, not a carrier's bill."],
    )


PAYMENT_COLUMNS = [
    "participating_order_count", "payment_value", "avg_max_installments", "avg_payment_sequences",
]


def payment_analysis(marts: MartSet, start: date, end: date, top_k: int = 10) -> MetricResult:
    """Mix of payment types. The share is over all types, before the limit; no status filter applies."""
    df = purchased_within(marts.payments, start, end)
    grouped = _metric_rows(df, [F.col("payment_type")], ["payment_type"], PAYMENT_COLUMNS)
    total = F.sum("payment_value").over(Window.partitionBy())  # over the few types
    rows = decimals_to_double(grouped.select(
        "payment_type", "participating_order_count", "payment_value",
        ratio(F.col("payment_value"), total, 10, 5).alias("payment_value_share"),
        "avg_max_installments", "avg_payment_sequences",
    )).orderBy(F.desc_nulls_first("payment_value"), F.asc("payment_type")).limit(top_k)
    top = rows.orderBy(F.desc_nulls_first("payment_value"), F.asc("payment_type")).limit(1)
    orders = df.groupBy("order_id").agg(F.lit(1).alias("one"))
    summary = orders.agg(F.count("order_id").alias("denominator")).select(
        top.select("payment_type").scalar().alias("value"),
        F.lit(None).cast("bigint").alias("numerator"), "denominator",
        data_freshness(marts).scalar().alias("data_freshness"),
    )
    return MetricResult(
        "payment_method_mix", rows, summary, _dates(start, end, top_k=top_k),
        "paid value and participating orders per payment type",
        ["One order can use several types, so the order counts overlap.",
         "Paid value is a field of the data, not settled cash."],
    )


# --- delivery and reviews --------------------------------------------------------------------------

DELIVERY_COLUMNS = [
    "order_count", "eligible_delivery_count", "late_order_count", "late_rate", "avg_late_days",
    "late_avg_review_score", "on_time_avg_review_score",
]


def delivery_performance(
    marts: MartSet, start: date, end: date, group_by: str = "overall", min_orders: int = 1, top_k: int = 10,
    delivered_only: bool = True,
) -> MetricResult:
    source, key, name = {
        "overall": (marts.orders, F.lit("overall").alias("group_key"), "group_key"),
        "seller_id": (marts.seller_orders, F.col("seller_id"), "seller_id"),
        "category": (marts.category_orders, F.col("category"), "category"),
    }[group_by]
    rows = decimals_to_double(
        _metric_rows(_filtered(source, start, end, delivered_only), [key], [name], DELIVERY_COLUMNS).filter(
            F.col("order_count") >= min_orders
        )
    ).orderBy(F.desc_nulls_last("late_rate"), F.desc("order_count"), F.asc(name)).limit(top_k)
    overall = group_by == "overall"
    return MetricResult(
        "late_delivery_rate", rows,
        _summary(
            marts, rows, F.max("late_rate") if overall else _no_value(),
            F.max("late_order_count") if overall else None,
            F.max("eligible_delivery_count") if overall else None,
        ),
        _dates(start, end, group_by=group_by, min_orders=min_orders, delivered_only=delivered_only),
        "late orders / orders whose actual and estimated delivery are both known",
    )


REVIEW_GROUP_COLUMNS = [
    "reviewed_order_count", "avg_review_score", "avg_group_late_days as avg_late_days",
]


def late_vs_on_time_reviews(marts: MartSet, start: date, end: date) -> MetricResult:
    df = _filtered(marts.orders, start, end, True).filter("is_late IS NOT NULL AND review_score IS NOT NULL")
    group = F.when(F.col("is_late"), F.lit("late")).otherwise(F.lit("on_time")).alias("delivery_group")
    exact = _metric_rows(df, [group], ["delivery_group"], REVIEW_GROUP_COLUMNS)
    rows = decimals_to_double(exact).orderBy("delivery_group")

    def score_of(name: str) -> Column:
        return F.max(F.when(F.col("delivery_group") == name, F.col("avg_review_score")))

    gap = F.round(score_of("late") - score_of("on_time"), 3).cast("double")
    summary = _summary(marts, exact, gap, denominator=_total("reviewed_order_count"))
    return MetricResult(
        "late_vs_on_time_review_score", rows, summary, _dates(start, end, order_status="delivered"),
        "mean score of late orders minus mean score of orders on time",
        ["The gap is an association, not a cause."],
    )


SELLER_COLUMNS = [
    "order_count", "item_value", "avg_order_value", "freight_share", "late_rate", "avg_review_score",
]


def peer_baseline(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over sellers with enough orders of their (unrounded) late rate and score."""
    wide = "decimal(28,14)"
    peers = sums.filter(F.col("orders") >= PEER_MINIMUM).select(
        *(by or []),
        (F.col("late").cast("decimal(20,0)") / F.nullif("eligible", F.lit(0))).cast(wide).alias("rate"),
        (F.col("score") / F.nullif("score_n", F.lit(0))).cast(wide).alias("mean_score"),
    )
    totals = peers.groupBy(*(by or [])).agg(
        F.sum("rate").alias("rate"), F.count("rate").alias("rate_n"),
        F.sum("mean_score").alias("mean_score"), F.count("mean_score").alias("mean_score_n"),
    )
    return totals.select(
        *(by or []),
        ratio(F.col("rate"), F.col("rate_n"), 10, 5).alias("baseline_late_rate"),
        ratio(F.col("mean_score"), F.col("mean_score_n"), 5, 2).alias("baseline_review_score"),
    )


def _seller_rows(marts: MartSet, start: date, end: date, seller_id: Any = None) -> DataFrame:
    df = purchased_within(marts.seller_orders, start, end)
    sums = measures.summed(df, ["seller_id"], SELLER_COLUMNS)
    baseline = peer_baseline(sums).select(F.struct("*").alias("baseline")).scalar()
    target = sums if seller_id is None else sums.filter(F.col("seller_id") == F.lit(seller_id))
    rows = target.select("seller_id", *measures.formulas(SELLER_COLUMNS), baseline.alias("baseline"))
    return decimals_to_double(rows.select(
        "seller_id", *SELLER_COLUMNS, "baseline.baseline_late_rate", "baseline.baseline_review_score"
    ))


def seller_diagnostic(marts: MartSet, start: date, end: date, seller_id: Any) -> MetricResult:
    rows = _seller_rows(marts, start, end, seller_id)
    return MetricResult(
        "seller_diagnostic", rows,
        _summary(marts, rows, F.max("late_rate"), denominator=F.max("order_count")),
        _dates(start, end, seller_id=seller_id),
        f"one seller at order-seller grain against sellers with at least {PEER_MINIMUM} orders",
        ["The peer mean describes, it is no causal benchmark."],
        empty_warning="No order of this seller lies in the range.",
    )


def seller_diagnostic_all(marts: MartSet, start: date, end: date) -> DataFrame:
    """The same figures for every seller in one job."""
    return _seller_rows(marts, start, end)


def review_excerpt(column: str) -> Column:
    return F.left(F.regexp_replace(F.coalesce(column, F.lit("")), "[\\n\\r\\t]+", " "), F.lit(EXCERPT_CHARS))


def review_samples(
    marts: MartSet, start: date, end: date, max_score: int = 2, limit: int = 20, late_only: bool | None = None
) -> MetricResult:
    kept = purchased_within(marts.reviews, start, end).filter(
        (F.col("review_score") <= max_score) & F.col("review_comment_message").isNotNull()
    )
    if late_only is not None:
        kept = kept.filter(F.col("is_late") if late_only else ~F.col("is_late"))
    rows = decimals_to_double(
        kept.orderBy(
            F.asc("review_score"), F.desc_nulls_first("review_created_at"), F.asc("review_id"), F.asc("order_id")
        ).limit(limit).select(
            "review_id", "order_id", "review_score", "is_late", "late_days",
            review_excerpt("review_comment_message").alias("comment_excerpt"),
        )
    )
    return MetricResult(
        "low_score_review_samples", rows,
        _summary(marts, rows, _row_count(), denominator=_row_count()),
        _dates(start, end, max_score=max_score, late_only=late_only),
        "excerpts of reviews at or below max_score",
        ["Excerpts are cut; nobody may be identified from them.", "Samples show cases, not how common they are."],
    )
