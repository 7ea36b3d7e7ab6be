"""Shared CTEs and the composer that adds to a query those CTEs it names."""

from __future__ import annotations

import re

CTE: dict[str, str] = {}


def compose(final: str) -> str:
    """``WITH <all CTEs that final needs, in order> final``."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in CTE:
            if name not in ordered and re.search(rf"\b{name}\b", sql):
                visit(CTE[name].replace(name, "") if name in RECURSIVE else CTE[name])
                if name not in ordered:
                    ordered.append(name)

    visit(final)
    if not ordered:
        return final
    parts = ",\n".join(f"{name} AS ({CTE[name]})" for name in ordered)
    return f"WITH RECURSIVE {parts}\n{final}"


RECURSIVE: set[str] = set()


def half_up(num: str, den: str, scale: int, unit: int = 1) -> str:
    """round(num / unit / den, scale) in integers, half up, NULL for den = 0, as DOUBLE."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    return (
        f"CASE WHEN {den} > 0 THEN CAST((2 * {n} * {10 ** scale} + {unit} * {d}) // (2 * {unit} * {d}) "
        f"AS DOUBLE) / {10 ** scale} END"
    )


def cents(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE) / 100"


BOUGHT = "(o_orderdate + INTERVAL 20 YEAR)"

CTE["x_span"] = """SELECT l_orderkey, CAST(min(l_quantity) AS INT) AS mn, CAST(max(l_quantity) AS INT) AS mx
    FROM lineitem GROUP BY l_orderkey"""

CTE["x_orders"] = f"""SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 997 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'delivered'
         WHEN o_orderstatus = 'O' THEN 'shipped' WHEN o_orderkey % 2 = 0 THEN 'canceled'
         ELSE 'unavailable' END AS order_status,
    {BOUGHT} AS purchased_at,
    CASE WHEN o_orderkey % 59 <> 0 THEN {BOUGHT} + to_days(CAST(o_orderkey % 5 - 1 AS INT)) END AS approved_at,
    {BOUGHT} + to_days(mn) + INTERVAL 12 HOUR AS carrier_at,
    CASE WHEN o_orderkey % 53 = 0 OR (o_orderstatus = 'P' AND o_orderkey % 11 <> 0) THEN NULL
         ELSE {BOUGHT} + to_days(mx) + to_seconds(o_orderkey * 37 % 86400) END AS delivered_at,
    CASE WHEN o_orderkey % 71 <> 0 THEN {BOUGHT} + INTERVAL 45 DAY END AS estimated_at
    FROM orders LEFT JOIN x_span ON o_orderkey = l_orderkey"""

CTE["x_items"] = """SELECT
    CASE WHEN l_orderkey % 499 = 0 AND l_linenumber = 7 THEN l_orderkey + 100000000 ELSE l_orderkey END AS order_id,
    l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
    l_shipdate AS shipping_limit_at,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS price_c, CAST(round(l_quantity * 100) AS BIGINT) AS freight_c
    FROM lineitem"""

CTE["x_payments"] = """SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
    CASE WHEN l_returnflag = 'A' THEN 'credit_card' WHEN l_returnflag = 'N' THEN 'boleto'
         WHEN l_linenumber = 7 THEN NULL ELSE 'voucher' END AS payment_type,
    l_linenumber + 1 AS payment_installments,
    CAST(round(l_extendedprice * 100) AS BIGINT)
      + CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(round(l_quantity * 100) AS BIGINT) END AS value_c
    FROM lineitem"""

CTE["x_reviews"] = f"""SELECT
    CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS review_id, o_orderkey AS order_id,
    CAST(1 + (o_orderkey * 31 + o_custkey) % 5 AS INT) AS review_score,
    CASE WHEN o_orderkey % 3 = 0 THEN 'title ' || o_orderkey END AS review_comment_title,
    text AS review_comment_message,
    CASE WHEN o_orderkey % 61 <> 0 THEN {BOUGHT} + INTERVAL 50 DAY END AS review_created_at,
    {BOUGHT} + INTERVAL 53 DAY AS review_answered_at
    FROM orders LEFT JOIN documents ON doc_id = o_orderkey WHERE o_orderkey % 10 <> 0
    UNION ALL
    SELECT o_orderkey + 1000000000, o_orderkey, CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS INT), 'follow-up',
    'short note', {BOUGHT} + INTERVAL 60 DAY, {BOUGHT} + INTERVAL 61 DAY
    FROM orders WHERE o_orderkey % 29 = 0"""

CTE["x_translation"] = """SELECT DISTINCT p_type AS raw_name, lower(p_type) AS english FROM part
    WHERE p_type <> 'SMALL'"""

CTE["x_products"] = """SELECT p_partkey AS product_id, kind AS product_category_name,
    coalesce(english, kind, 'unknown') AS category, *
    FROM (SELECT *, CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS kind FROM part)
    LEFT JOIN x_translation ON raw_name = kind"""

CTE["x_customers"] = """SELECT c_custkey AS customer_id, c_custkey % 1000 AS customer_unique_id,
    CAST(c_custkey AS INT) AS zip_prefix, c_mktsegment AS customer_city,
    CASE WHEN c_custkey % 83 <> 0 THEN n_name END AS customer_state
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

CTE["x_sellers"] = """SELECT s_suppkey AS seller_id, CAST(s_suppkey AS INT) AS zip_prefix, s_name AS seller_city,
    n_name AS seller_state FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""


def _milli_days(start: str, end: str) -> str:
    micros = f"CAST(date_diff('microsecond', {start}, {end}) AS HUGEINT)"
    return f"CAST((2000 * {micros} + 86400000000) // 172800000000 AS BIGINT)"


# Marts in integers: *_c = hundredths, *_md = thousandths of a day.
CTE["o_items"] = """SELECT order_id, count(*) AS item_count, count(DISTINCT seller_id) AS seller_count,
    CAST(sum(price_c) AS BIGINT) AS goods_c, CAST(sum(freight_c) AS BIGINT) AS freight_c
    FROM x_items GROUP BY order_id"""
CTE["o_payments"] = """SELECT order_id, CAST(sum(value_c) AS BIGINT) AS paid_c,
    max(payment_installments) AS max_installments FROM x_payments GROUP BY order_id"""
CTE["o_reviews"] = """SELECT order_id,
    CAST((200 * sum(review_score) + count(review_score)) // (2 * count(review_score)) AS BIGINT) AS score_c,
    string_agg(review_comment_title, ' | ' ORDER BY review_created_at ASC NULLS LAST, review_id) AS review_titles,
    string_agg(review_comment_message, chr(10) || '---' || chr(10)
      ORDER BY review_created_at ASC NULLS LAST, review_id) AS review_messages,
    min(review_created_at) AS first_review_at FROM x_reviews GROUP BY order_id"""
CTE["o_timing"] = f"""SELECT *, delivered_at > estimated_at AS is_late,
    CASE WHEN delivered_at > estimated_at THEN {_milli_days('estimated_at', 'delivered_at')} ELSE 0 END AS late_md,
    {_milli_days('purchased_at', 'delivered_at')} AS delivery_md FROM x_orders"""
CTE["m_orders"] = """SELECT o.*, c.customer_unique_id, c.customer_city, c.customer_state,
    coalesce(i.item_count, 0) AS item_count, coalesce(i.seller_count, 0) AS seller_count,
    coalesce(i.goods_c, 0) AS goods_c, coalesce(i.freight_c, 0) AS freight_c, p.paid_c, p.max_installments,
    r.score_c, r.review_titles, r.review_messages, r.first_review_at
    FROM o_timing o LEFT JOIN x_customers c ON o.customer_id = c.customer_id
    LEFT JOIN o_items i ON o.order_id = i.order_id LEFT JOIN o_payments p ON o.order_id = p.order_id
    LEFT JOIN o_reviews r ON o.order_id = r.order_id"""
CTE["m_sellers"] = """SELECT s.order_id, s.seller_id, se.seller_city, se.seller_state, o.order_status, o.purchased_at,
    o.delivered_at, o.estimated_at, o.is_late, o.late_md, o.score_c, s.item_count, s.goods_c, s.freight_c,
    s.first_limit, s.last_limit
    FROM (SELECT order_id, seller_id, count(*) AS item_count, CAST(sum(price_c) AS BIGINT) AS goods_c,
            CAST(sum(freight_c) AS BIGINT) AS freight_c, min(shipping_limit_at) AS first_limit,
            max(shipping_limit_at) AS last_limit FROM x_items GROUP BY order_id, seller_id) s
    JOIN m_orders o ON s.order_id = o.order_id LEFT JOIN x_sellers se ON s.seller_id = se.seller_id"""
CTE["m_categories"] = """SELECT c.order_id, coalesce(c.category, 'unknown') AS category, o.order_status, o.purchased_at,
    o.delivered_at, o.estimated_at, o.is_late, o.late_md, o.score_c, c.item_count, c.goods_c, c.freight_c
    FROM (SELECT i.order_id, p.category, count(*) AS item_count, CAST(sum(price_c) AS BIGINT) AS goods_c,
            CAST(sum(freight_c) AS BIGINT) AS freight_c
          FROM x_items i LEFT JOIN x_products p ON i.product_id = p.product_id GROUP BY i.order_id, p.category) c
    JOIN m_orders o ON c.order_id = o.order_id"""
CTE["m_reviews"] = """SELECT r.*, o.purchased_at, o.order_status, o.is_late, o.late_md, o.delivery_md
    FROM x_reviews r JOIN m_orders o ON r.order_id = o.order_id"""
CTE["m_payments"] = """SELECT p.order_id, p.kind AS payment_type, p.paid_c, p.most, p.n, o.purchased_at, o.order_status,
    o.customer_state, o.goods_c, o.freight_c, o.is_late, o.score_c
    FROM (SELECT order_id, coalesce(payment_type, 'unknown') AS kind, CAST(sum(value_c) AS BIGINT) AS paid_c,
            max(payment_installments) AS most, count(*) AS n
          FROM x_payments GROUP BY order_id, coalesce(payment_type, 'unknown')) p
    JOIN m_orders o ON p.order_id = o.order_id"""
