"""Named, typed, read-only metrics: ``run_metric(marts, name, **parameters)``."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from datetime import date
from typing import Any

from parcelmart.operators import metrics as m

SELLER_ID = r"[0-9a-f]{32}"


def _within(name: str, value: int, low: int, high: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")


@dataclass(frozen=True)
class DateRange:
    start: date
    end: date

    def __post_init__(self) -> None:
        for name in ("start", "end"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, date.fromisoformat(value))
        if self.end < self.start:
            raise ValueError("end must be on or after start")
        self.check()

    def check(self) -> None:
        """Further limits of a metric's own parameters."""


@dataclass(frozen=True)
class MonthlyTrend(DateRange):
    delivered_only: bool = False


@dataclass(frozen=True)
class GeographyPerformance(DateRange):
    min_orders: int = 20
    top_k: int = 27
    delivered_only: bool = True

    def check(self) -> None:
        _within("min_orders", self.min_orders, 1, 100_000)
        _within("top_k", self.top_k, 1, 100)


@dataclass(frozen=True)
class _Grouped(DateRange):
    group_by: str = "overall"
    min_orders: int = 1
    top_k: int = 10
    delivered_only: bool = True
    groups = ("overall",)

    def check(self) -> None:
        if self.group_by not in self.groups:
            raise ValueError(f"group_by must be one of {', '.join(self.groups)}")
        _within("min_orders", self.min_orders, 1, 100_000)
        _within("top_k", self.top_k, 1, 100)


@dataclass(frozen=True)
class FreightAnalysis(_Grouped):
    groups = ("overall", "customer_state", "category")


@dataclass(frozen=True)
class DeliveryPerformance(_Grouped):
    groups = ("overall", "seller_id", "category")


@dataclass(frozen=True)
class PaymentAnalysis(DateRange):
    top_k: int = 10

    def check(self) -> None:
        _within("top_k", self.top_k, 1, 20)


@dataclass(frozen=True)
class SellerDiagnostic(DateRange):
    seller_id: Any = None
    seller_pattern: str = SELLER_ID

    def check(self) -> None:
        if self.seller_id is None or not re.fullmatch(self.seller_pattern, str(self.seller_id)):
            raise ValueError(f"seller_id must match {self.seller_pattern}")


@dataclass(frozen=True)
class ReviewSamples(DateRange):
    max_score: int = 2
    limit: int = 20
    late_only: bool | None = None

    def check(self) -> None:
        _within("max_score", self.max_score, 1, 5)
        _within("limit", self.limit, 1, 100)


#: Name -> (parameters, function). Every metric only reads.
METRICS: dict[str, tuple[type[DateRange], Callable[..., m.MetricResult]]] = {
    "sales_summary": (DateRange, m.sales_summary),
    "delivery_performance": (DeliveryPerformance, m.delivery_performance),
    "operations_overview": (DateRange, m.operations_overview),
    "monthly_trend": (MonthlyTrend, m.monthly_trend),
    "geography_performance": (GeographyPerformance, m.geography_performance),
    "freight_analysis": (FreightAnalysis, m.freight_analysis),
    "payment_analysis": (PaymentAnalysis, m.payment_analysis),
    "late_vs_on_time_reviews": (DateRange, m.late_vs_on_time_reviews),
    "seller_diagnostic": (SellerDiagnostic, m.seller_diagnostic),
    "review_samples": (ReviewSamples, m.review_samples),
}


def list_metrics() -> list[str]:
    return list(METRICS)


def run_metric(marts: m.MartSet, name: str, **parameters: Any) -> m.MetricResult:
    """The metric ``name`` over checked parameters; lazy."""
    if name not in METRICS:
        raise KeyError(f"unknown metric: {name}")
    kind, function = METRICS[name]
    allowed = {f.name for f in fields(kind)}
    if unknown := set(parameters) - allowed:
        raise ValueError(f"unknown parameters of {name}: {', '.join(sorted(unknown))}")
    checked = kind(**parameters)
    return function(marts, **{f: getattr(checked, f) for f in allowed if f != "seller_pattern"})
