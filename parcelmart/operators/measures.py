"""Additive measures over mart rows.

Every metric is a formula over these sums and counts. Because they add up, the same formulas serve
one metric call (aggregate the filtered mart), the monthly marts, and a whole table of requests
(aggregate once per day, then add days per request).

Counts of orders are plain counts: each mart is unique at its grain (``operators.keys`` checks it), so
``count(distinct order_id)`` per key equals ``count(order_id)`` without expanding the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmart.functions.numbers import count_ratio, mean, money, ratio

DELIVERED = "delivered"


def _where(condition: Column, value: str) -> Column:
    return F.when(condition, F.col(value))


def _money_sum(value: str) -> Column:
    """Sum of money with room for 10^22, yet narrow enough that a division keeps 14 digits.

    Every SUM widens a decimal by ten digits, and a division of two wide decimals falls back to scale 6:
    a share of 0.0004946 would then round twice, to 0.00050.
    """
    return F.sum(value).cast("decimal(24,2)")


def _definitions() -> dict[str, Column]:
    late, on_time = F.col("is_late"), ~F.col("is_late")
    delivered = F.col("order_status") == DELIVERED
    return {
        "orders": F.count("order_id"),
        "delivered_orders": F.count(_where(delivered, "order_id")),
        "eligible": F.count("is_late"),
        "late": F.count_if(late),
        "late_days_late": F.sum(_where(late, "late_days")),
        "late_days_all": F.sum("late_days"),
        "delivery_days": F.sum("delivery_days"),
        "delivery_days_n": F.count("delivery_days"),
        "delivery_days_delivered": F.sum(_where(delivered, "delivery_days")),
        "delivery_days_delivered_n": F.count(_where(delivered, "delivery_days")),
        "score": F.sum("review_score"),
        "score_n": F.count("review_score"),
        "score_late": F.sum(_where(late, "review_score")),
        "score_late_n": F.count(_where(late, "review_score")),
        "score_on_time": F.sum(_where(on_time, "review_score")),
        "score_on_time_n": F.count(_where(on_time, "review_score")),
        "goods": _money_sum("item_value"),
        "freight": _money_sum("freight_value"),
        "paid": _money_sum("payment_value"),
        "installments": F.sum("max_installments"),
        "installments_n": F.count("max_installments"),
        "sequences": F.sum("payment_sequence_count"),
        "sequences_n": F.count("payment_sequence_count"),
    }


MEASURE_NAMES = (
    "orders", "delivered_orders", "eligible", "late", "late_days_late", "late_days_all", "delivery_days",
    "delivery_days_n", "delivery_days_delivered", "delivery_days_delivered_n", "score", "score_n",
    "score_late", "score_late_n", "score_on_time", "score_on_time_n", "goods", "freight", "paid",
    "installments", "installments_n", "sequences", "sequences_n",
)

MONEY = ("goods", "freight", "paid")

# Which measures each result column needs, and its formula over them.
FORMULAS: dict[str, tuple[tuple[str, ...], Column]] = {}


def _formula(name: str, needs: tuple[str, ...], build) -> None:
    FORMULAS[name] = (needs, build)


_formula("order_count", ("orders",), lambda: F.col("orders"))
_formula("participating_order_count", ("orders",), lambda: F.col("orders"))
_formula("reviewed_order_count", ("orders",), lambda: F.col("orders"))
_formula("delivered_order_count", ("delivered_orders",), lambda: F.col("delivered_orders"))
_formula("eligible_delivery_count", ("eligible",), lambda: F.col("eligible"))
_formula("late_order_count", ("late",), lambda: F.col("late"))
_formula("late_rate", ("late", "eligible"), lambda: count_ratio("late", "eligible"))
_formula("avg_late_days", ("late_days_late", "late"), lambda: mean("late_days_late", "late", 10, 3))
_formula("avg_group_late_days", ("late_days_all", "orders"), lambda: mean("late_days_all", "orders", 10, 3))
_formula("avg_delivery_days", ("delivery_days", "delivery_days_n"),
         lambda: mean("delivery_days", "delivery_days_n", 10, 3))
_formula("avg_delivered_days", ("delivery_days_delivered", "delivery_days_delivered_n"),
         lambda: mean("delivery_days_delivered", "delivery_days_delivered_n", 10, 3))
_formula("avg_review_score", ("score", "score_n"), lambda: mean("score", "score_n", 5, 2))
_formula("late_avg_review_score", ("score_late", "score_late_n"), lambda: mean("score_late", "score_late_n", 5, 2))
_formula("on_time_avg_review_score", ("score_on_time", "score_on_time_n"),
         lambda: mean("score_on_time", "score_on_time_n", 5, 2))
_formula("item_value", ("goods",), lambda: money("goods"))
_formula("gmv_proxy", ("goods",), lambda: money("goods"))
_formula("freight_value", ("freight",), lambda: money("freight"))
_formula("avg_order_value", ("goods", "orders"), lambda: mean("goods", "orders", 16, 2))
_formula("avg_freight_per_order", ("freight", "orders"), lambda: mean("freight", "orders", 16, 2))
_formula("freight_share", ("freight", "goods"),
         lambda: ratio(F.col("freight"), F.col("goods") + F.col("freight"), 10, 5))
_formula("payment_value", ("paid",), lambda: money("paid"))
_formula("avg_max_installments", ("installments", "installments_n"),
         lambda: ratio(F.col("installments").cast("decimal(20,0)"), F.col("installments_n"), 10, 2))
_formula("avg_payment_sequences", ("sequences", "sequences_n"),
         lambda: ratio(F.col("sequences").cast("decimal(20,0)"), F.col("sequences_n"), 10, 2))


def needed(columns: list[str]) -> list[str]:
    wanted = {m for c in columns for m in FORMULAS[c.split(" as ")[0]][0]}
    return [m for m in MEASURE_NAMES if m in wanted]


def summed(df: DataFrame, keys: list[Column | str], columns: list[str]) -> DataFrame:
    """First step: one row per key with the measures that ``columns`` need."""
    definitions = _definitions()
    aggregates = [definitions[m].alias(m) for m in needed(columns)]
    return df.groupBy(*keys).agg(*aggregates)


def narrowed(measure: str, total: Column) -> Column:
    """A total of sums as wide as the sum itself."""
    return total.cast("decimal(24,2)") if measure in MONEY else total


def formulas(columns: list[str]) -> list[Column]:
    """Second step: result columns; ``"a as b"`` renames formula ``a``."""
    out = []
    for entry in columns:
        name, _, alias = entry.partition(" as ")
        out.append(FORMULAS[name][1]().alias(alias or name))
    return out
