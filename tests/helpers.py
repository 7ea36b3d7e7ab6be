"""Hand-made staging frames."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from parcelmart.operators.staging import Staging

ORDERS = ("order_id string, customer_id string, order_status string, purchased_at timestamp_ntz, "
          "approved_at timestamp_ntz, carrier_at timestamp_ntz, delivered_at timestamp_ntz, estimated_at timestamp_ntz")
ITEMS = ("order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_at timestamp_ntz, "
         "price decimal(14,2), freight_value decimal(14,2)")
PAYMENTS = ("order_id string, payment_sequential int, payment_type string, payment_installments int, "
            "payment_value decimal(14,2)")
REVIEWS = ("review_id string, order_id string, review_score int, review_comment_title string, "
           "review_comment_message string, review_created_at timestamp_ntz, review_answered_at timestamp_ntz")


def at(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


def money(value) -> Decimal:
    return Decimal(str(value))


def order(key, status="delivered", bought="2018-07-10", delivered="2018-07-20", estimated="2018-07-25", customer="c1"):
    return (key, customer, status, at(bought), at(bought), at(bought), at(delivered), at(estimated))


def item(key, number=1, product="p1", seller="s1", price=10, freight=2):
    return (key, number, product, seller, at("2018-07-15"), money(price), money(freight))


def payment(key, number=1, kind="credit_card", installments=1, value=12):
    return (key, number, kind, installments, money(value))


def review(ident, key, score=5, title=None, message=None, created="2018-08-01"):
    return (ident, key, score, title, message, at(created), None)


def staging(spark, orders, items=(), payments=(), reviews=(), products=(("p1", "toys"),), sellers=("s1",)):
    return Staging(
        orders=spark.createDataFrame(list(orders), ORDERS),
        items=spark.createDataFrame(list(items), ITEMS),
        payments=spark.createDataFrame(list(payments), PAYMENTS),
        reviews=spark.createDataFrame(list(reviews), REVIEWS),
        products=spark.createDataFrame(list(products), "product_id string, category string"),
        customers=spark.createDataFrame(
            [("c1", "u1", 1, "city", "SP"), ("c2", "u2", 2, "town", None)],
            "customer_id string, customer_unique_id string, zip_prefix int, customer_city string, customer_state string",
        ),
        sellers=spark.createDataFrame(
            [(s, 1, "city", "SP") for s in sellers],
            "seller_id string, zip_prefix int, seller_city string, seller_state string",
        ),
    )
