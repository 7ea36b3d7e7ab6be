from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelmart.operators import marts, staging as stage
from parcelmart.operators.keys import DuplicateKeyError, assert_unique, duplicate_keys
from parcelmart.plans.warehouse import MART_KEYS, marts_from_staging, order_buckets, refresh_marts
from parcelmart.schemas import raw_schema
from tests.conftest import rows
from tests.helpers import item, order, payment, review, staging


def raw(spark, table, *values):
    return spark.createDataFrame(list(values), raw_schema(table))


def test_empty_text_is_null_and_bad_text_is_an_error(spark):
    good = raw(spark, "orders", ("o1", "c1", "", "2018-07-01 10:00:00", "", "", None, "2018-07-09 00:00:00"))
    row = stage.stg_orders(good).first()
    assert row.order_status is None and row.approved_at is None and row.delivered_at is None
    assert row.purchased_at.hour == 10
    bad = raw(spark, "orders", ("o1", "c1", "x", "not a time", "", "", "", ""))
    with pytest.raises(PySparkException):
        stage.stg_orders(bad).collect()


def test_category_falls_back_to_source_name_then_unknown(spark):
    products = raw(
        spark, "products", ("p1", "brinquedos", "3", "4", "", "1.5", "", "", ""),
        ("p2", "novo", *[None] * 7), ("p3", None, *[None] * 7),
    )
    translation = raw(spark, "category_translation", ("brinquedos", "toys"))
    found = {r.product_id: r for r in stage.stg_products(products, translation).collect()}
    assert [found[p].category for p in ("p1", "p2", "p3")] == ["toys", "novo", "unknown"]
    assert found["p1"].product_photos_qty is None and found["p1"].product_weight_g == Decimal("1.5")


def test_items_sellers_payments_and_reviews_do_not_multiply(spark):
    stg = staging(
        spark, [order("o1")], [item("o1", 1), item("o1", 2, seller="s2", price=5), item("o1", 3, seller="s2")],
        [payment("o1", 1, value=20), payment("o1", 2, "voucher", 3, 11)],
        [review("r1", "o1", 4, "b", "m2", "2018-08-02"), review("r2", "o1", 5, "a", "m1", "2018-08-01"),
         review("r3", "o1", 4, None, "m3", None)],
    )
    row = marts_from_staging(stg).orders.first()
    assert (row.item_count, row.seller_count, row.item_value, row.freight_value) == (3, 2, Decimal("25.00"), Decimal("6.00"))
    assert (row.payment_value, row.max_installments) == (Decimal("31.00"), 3)
    assert row.review_score == Decimal("4.33")
    assert row.review_titles == "a | b"
    assert row.review_messages == "m1\n---\nm2\n---\nm3"
    assert marts_from_staging(stg).seller_orders.count() == 2


def test_lateness_is_three_valued_and_late_days_default_to_zero(spark):
    stg = staging(spark, [
        order("late", delivered="2018-07-26T12:00:00"), order("edge", delivered="2018-07-25"),
        order("open", delivered=None), order("vague", estimated=None),
    ])
    found = {r.order_id: r for r in marts_from_staging(stg).orders.collect()}
    assert [found[k].is_late for k in ("late", "edge", "open", "vague")] == [True, False, None, None]
    assert [found[k].late_days for k in ("late", "edge", "open")] == [Decimal("1.500"), 0, 0]
    assert found["late"].delivery_days == Decimal("16.500") and found["open"].delivery_days is None
    assert found["late"].item_value == 0 and found["late"].payment_value is None


def test_days_do_not_depend_on_the_session_time_zone(spark):
    frame = staging(spark, [order("o", bought="2018-03-01", delivered="2018-04-01")]).orders
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert marts.order_timing(frame).first().delivery_days == Decimal("31.000")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unmatched_product_becomes_unknown_after_grouping(spark):
    stg = staging(spark, [order("o1")], [item("o1", 1, "gone"), item("o1", 2, "p9")], products=[("p9", "unknown")])
    mart = marts_from_staging(stg).category_orders
    assert [r.category for r in mart.collect()] == ["unknown", "unknown"]
    with pytest.raises(DuplicateKeyError):
        assert_unique(mart, ["order_id", "category"], "category mart")


def test_repeated_review_ids_stay_and_orphans_leave(spark):
    stg = staging(spark, [order("o1"), order("o2")], [item("zz")], [], [review("r", "o1"), review("r", "o2"), review("x", "zz")])
    built = marts_from_staging(stg)
    assert sorted(r.order_id for r in built.reviews.collect()) == ["o1", "o2"]
    assert built.seller_orders.count() == 0


def test_one_hot_order_is_combined_before_the_shuffle(spark):
    """A third of all items in one order: same sums, and the plan aggregates partially first."""
    items = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("o"), F.col("id").cast("string"))).alias("order_id"),
        F.lit(1).alias("order_item_id"), F.lit("p1").alias("product_id"),
        (F.col("id") % 7).cast("string").alias("seller_id"), F.lit(None).cast("timestamp_ntz").alias("shipping_limit_at"),
        F.lit("1.10").cast("decimal(14,2)").alias("price"), F.lit("0.10").cast("decimal(14,2)").alias("freight_value"),
    )
    grouped = marts.order_item_agg(items)
    hot = grouped.filter("order_id = 'hot'").first()
    assert (hot.item_count, hot.seller_count, hot.item_value) == (10_000, 7, Decimal("11000.00"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.index("Exchange") < plan.rindex("partial_sum")


def test_a_refresh_moves_facts_once_and_checks_keys_without_a_shuffle(spark, tmp_path):
    many = [f"o{i}" for i in range(40)]
    stg = staging(
        spark, [order(k) for k in many], [item(k, n, seller=f"s{n}") for k in many for n in (1, 2)],
        [payment(k, n, kind) for k in many for n, kind in ((1, "voucher"), (2, None))], [review(f"r{k}", k, 4, None, "m") for k in many],
        sellers=("s1", "s2"),
    )
    found = refresh_marts(spark, stg, str(tmp_path), buckets=3)
    lazy = marts_from_staging(stg)
    for name, (_, keys) in MART_KEYS.items():
        mart = getattr(found, name).drop("purchase_month")
        assert rows(mart) == rows(getattr(lazy, name))
        assert not keys or "order_id" not in keys or "Exchange" not in plan_of(duplicate_keys(mart, keys))
    assert "Exchange" not in plan_of(found.payments.hint("merge").join(found.orders.select("order_id", "customer_id"), "order_id"))


def test_order_buckets_follow_the_rows(spark):
    def count(n):
        return order_buckets(replace(staging(spark, [order("o")]), items=spark.range(n)))

    assert [count(n) for n in (0, 500_000, 3_000_000, 40_000_000)] == [1, 2, 8, 20]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
