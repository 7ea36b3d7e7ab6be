from __future__ import annotations

from datetime import date

import pytest

from parcelmart.operators import metrics
from parcelmart.plans.catalog import list_metrics, run_metric
from parcelmart.plans.warehouse import marts_from_staging
from parcelmart.registry.warehouse import END, START, stored_marts
from tests.helpers import item, order, payment, review, staging

JULY = (date(2018, 7, 1), date(2018, 7, 31))


@pytest.fixture(scope="module")
def small(spark):
    return marts_from_staging(staging(
        spark,
        [order("a", delivered="2018-07-27"), order("b"), order("c", "canceled", delivered=None),
         order("d", None, bought="2018-07-31T23:59:59", customer="c2"), order("e", bought="2018-08-01")],
        [item("a"), item("b", seller="s2", price=30), item("d"), item("e")],
        [payment("a", value=12), payment("b", kind="boleto", value=32), payment("b", 2, None, 4, 1)],
        [review("r1", "a", 1, message="very\nlate\r\n\tparcel"), review("r2", "b", 5), review("r3", "d", 2, message="so so")],
    ))


@pytest.fixture(scope="module")
def marts(spark, folder):
    return stored_marts(spark, folder)


def test_range_includes_the_whole_last_day(small):
    overview = metrics.operations_overview(small, *JULY)
    assert {r.order_status: r.order_count for r in overview.rows.collect()} == {
        "delivered": 2, "canceled": 1, "unknown": 1
    }
    head = overview.summary.first()
    assert (head.value, head.numerator, head.denominator) == (4, 1, 4)
    assert head.data_freshness == date(2018, 8, 1)


def test_sales_of_an_empty_range_is_one_row_of_nulls(small):
    rows = metrics.sales_summary(small, date(2010, 1, 1), date(2010, 1, 2)).rows.collect()
    assert len(rows) == 1 and rows[0].order_count == 0 and rows[0].gmv_proxy is None
    assert metrics.delivery_performance(small, date(2010, 1, 1), date(2010, 1, 2)).rows.count() == 0


def test_share_is_over_all_types_before_the_limit(small):
    result = metrics.payment_analysis(small, *JULY, top_k=1)
    row = result.rows.collect()
    assert len(row) == 1 and row[0].payment_type == "boleto" and row[0].payment_value_share == 0.71111
    head = result.summary.first()
    assert (head.value, head.denominator) == ("boleto", 2)


def test_late_and_on_time_scores(small):
    result = metrics.late_vs_on_time_reviews(small, *JULY)
    assert [(r.delivery_group, r.avg_review_score, r.avg_late_days) for r in result.rows.collect()] == [
        ("late", 1.0, 2.0), ("on_time", 5.0, 0.0)
    ]
    assert result.summary.first().value == -4.0


def test_review_samples_filter_and_excerpt(small):
    rows = metrics.review_samples(small, *JULY).rows.collect()
    assert [(r.review_id, r.comment_excerpt) for r in rows] == [("r1", "very late parcel"), ("r3", "so so")]
    assert [r.review_id for r in metrics.review_samples(small, *JULY, late_only=True).rows.collect()] == ["r1"]
    assert [r.review_id for r in metrics.review_samples(small, *JULY, late_only=False).rows.collect()] == ["r3"]


def test_seller_without_orders_has_no_row_but_a_warning(small):
    found = metrics.seller_diagnostic(small, *JULY, "nobody").envelope()
    assert found["rows"] == [] and found["value"] is None and "No order" in found["warnings"][0]
    known = metrics.seller_diagnostic(small, *JULY, "s1").envelope()
    assert known["value"] == 0.5 and known["denominator"] == 2 and known["rows"][0]["baseline_late_rate"] is None


def test_small_shares_are_rounded_once(spark):
    stg = staging(spark, [order("a")], [item("a", price="50719483.63", freight="25100.00")])
    row = metrics.freight_analysis(marts_from_staging(stg), *JULY).rows.first()
    assert row.freight_share == 0.00049  # 0.00049463...; rounding at six places first would give 0.0005


def test_invariants_on_the_test_tables(marts):
    overall = metrics.delivery_performance(marts, START, END).rows.collect()
    assert len(overall) == 1 and overall[0].late_order_count <= overall[0].eligible_delivery_count
    trend = metrics.monthly_trend(marts, START, END)
    months = [r.month for r in trend.rows.collect()]
    assert months == sorted(months) and trend.summary.first().value == len(months)
    states = metrics.geography_performance(marts, START, END, 5, 7).rows.collect()
    assert len(states) <= 7 and all(r.order_count >= 5 for r in states)
    freight = metrics.freight_analysis(marts, START, END).rows.first()
    assert 0 < freight.freight_share < 1
    payments = metrics.payment_analysis(marts, START, END, 20).rows.collect()
    assert abs(sum(r.payment_value_share for r in payments) - 1) < 1e-4


def test_month_folders_outside_the_range_are_not_read(marts):
    plan = metrics.sales_summary(marts, *JULY).rows._jdf.queryExecution().executedPlan().toString()
    assert "purchase_month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_catalogue_validates_and_refuses(marts):
    assert list_metrics() == [
        "sales_summary", "delivery_performance", "operations_overview", "monthly_trend", "geography_performance",
        "freight_analysis", "payment_analysis", "late_vs_on_time_reviews", "seller_diagnostic", "review_samples",
    ]
    rows = run_metric(marts, "sales_summary", start="2017-01-01", end="2018-12-31").envelope()["rows"]
    assert len(rows) == 1
    for name, more in (
        ("sales_summary", {"end": "2016-01-01"}), ("delivery_performance", {"top_k": 101}),
        ("delivery_performance", {"group_by": "customer_state"}), ("payment_analysis", {"top_k": 21}),
        ("review_samples", {"max_score": 6}), ("seller_diagnostic", {"seller_id": "XYZ"}),
        ("geography_performance", {"min_orders": 0}), ("sales_summary", {"colour": "red"}),
    ):
        with pytest.raises(ValueError):
            run_metric(marts, name, **{"start": "2017-01-01", "end": "2017-12-31"} | more)
    with pytest.raises(KeyError):
        run_metric(marts, "drop_everything")
