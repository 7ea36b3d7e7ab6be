"""Oracle SQL of staging, marts, metrics and quality checks."""

from __future__ import annotations

from oracle.base import CTE, cents, compose, half_up

DAYS = "CAST({} AS DOUBLE) / 1000"
RANGE = "purchased_at >= DATE '2017-01-01' AND purchased_at < DATE '2019-01-01'"
DONE = "AND order_status = 'delivered'"

SQL: dict[str, str] = {}

# --- staging ---------------------------------------------------------------------------------------
SQL["stg_orders"] = """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
    order_status, purchased_at, approved_at, carrier_at, delivered_at, estimated_at FROM x_orders"""
SQL["stg_order_items"] = f"""SELECT CAST(order_id AS VARCHAR) AS order_id, order_item_id,
    CAST(product_id AS VARCHAR) AS product_id, CAST(seller_id AS VARCHAR) AS seller_id, shipping_limit_at,
    {cents('price_c')} AS price, {cents('freight_c')} AS freight_value FROM x_items"""
SQL["stg_order_payments"] = f"""SELECT CAST(order_id AS VARCHAR) AS order_id, payment_sequential, payment_type,
    payment_installments, {cents('value_c')} AS payment_value FROM x_payments"""
SQL["stg_reviews"] = """SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id,
    review_score, review_comment_title, review_comment_message, review_created_at, review_answered_at FROM x_reviews"""
SQL["stg_products"] = """SELECT product_id, product_category_name, category,
    CAST(length(p_name) AS INT) AS product_name_length, CAST(p_size * 20 AS INT) AS product_description_length,
    CAST(CASE WHEN p_partkey % 30 <> 0 THEN p_partkey % 7 END AS INT) AS product_photos_qty,
    CASE WHEN p_partkey % 40 <> 0 THEN CAST(p_size * 10 AS DOUBLE) END AS product_weight_g,
    CAST(p_size + 5 AS DOUBLE) AS product_length_cm, CAST(p_size AS DOUBLE) / 4 AS product_height_cm,
    CAST(p_size + 2 AS DOUBLE) AS product_width_cm FROM x_products"""
SQL["stg_customers"] = """SELECT CAST(customer_id AS VARCHAR) AS customer_id,
    CAST(customer_unique_id AS VARCHAR) AS customer_unique_id, zip_prefix, customer_city, customer_state
    FROM x_customers"""
SQL["stg_sellers"] = """SELECT CAST(seller_id AS VARCHAR) AS seller_id, zip_prefix, seller_city, seller_state
    FROM x_sellers"""

# --- marts -----------------------------------------------------------------------------------------
_SCORE = cents("score_c")
SQL["order_item_agg"] = f"""SELECT order_id, item_count, seller_count, {cents('goods_c')} AS item_value,
    {cents('freight_c')} AS freight_value FROM o_items"""
SQL["order_payment_agg"] = f"""SELECT order_id, {cents('paid_c')} AS payment_value, max_installments FROM o_payments"""
SQL["order_review_agg"] = f"""SELECT order_id, {_SCORE} AS review_score, review_titles, review_messages,
    first_review_at FROM o_reviews"""
SQL["order_timing"] = f"""SELECT order_id, is_late, {DAYS.format('late_md')} AS late_days,
    {DAYS.format('delivery_md')} AS delivery_days FROM o_timing"""
SQL["late_flag"] = "SELECT order_id, is_late FROM o_timing"
SQL["late_days"] = f"SELECT order_id, {DAYS.format('late_md')} AS late_days FROM o_timing"
SQL["delivery_days"] = f"SELECT order_id, {DAYS.format('delivery_md')} AS delivery_days FROM o_timing"
SQL["mart_order_fulfillment"] = f"""SELECT order_id, customer_id, customer_unique_id, customer_city, customer_state,
    order_status, purchased_at, approved_at, carrier_at, delivered_at, estimated_at, is_late,
    {DAYS.format('late_md')} AS late_days, {DAYS.format('delivery_md')} AS delivery_days, item_count, seller_count,
    {cents('goods_c')} AS item_value, {cents('freight_c')} AS freight_value, {cents('paid_c')} AS payment_value,
    max_installments, {_SCORE} AS review_score, review_titles, review_messages, first_review_at FROM m_orders"""
SQL["mart_seller_order_fulfillment"] = f"""SELECT order_id, seller_id, seller_city, seller_state, order_status,
    purchased_at, delivered_at, estimated_at, is_late, {DAYS.format('late_md')} AS late_days, {_SCORE} AS review_score,
    item_count, {cents('goods_c')} AS item_value, {cents('freight_c')} AS freight_value,
    first_limit AS first_shipping_limit_at, last_limit AS last_shipping_limit_at FROM m_sellers"""
SQL["mart_category_order_fulfillment"] = f"""SELECT order_id, category, order_status, purchased_at, delivered_at,
    estimated_at, is_late, {DAYS.format('late_md')} AS late_days, {_SCORE} AS review_score, item_count,
    {cents('goods_c')} AS item_value, {cents('freight_c')} AS freight_value FROM m_categories"""
SQL["mart_review_analysis_base"] = f"""SELECT review_id, order_id, review_score, review_comment_title,
    review_comment_message, review_created_at, purchased_at, order_status, is_late,
    {DAYS.format('late_md')} AS late_days, {DAYS.format('delivery_md')} AS delivery_days FROM m_reviews"""
SQL["mart_payment_analysis_base"] = f"""SELECT order_id, payment_type, {cents('paid_c')} AS payment_value,
    most AS max_installments, n AS payment_sequence_count, purchased_at, order_status, customer_state,
    {cents('goods_c')} AS item_value, {cents('freight_c')} AS freight_value, is_late, {_SCORE} AS review_score
    FROM m_payments"""

# --- measures and formulas -------------------------------------------------------------------------
F = {
    "orders": "count(order_id)",
    "done": "count(order_id) FILTER (WHERE order_status = 'delivered')",
    "eligible": "count(is_late)",
    "late": "count(*) FILTER (WHERE is_late)",
    "gmv": cents("sum(goods_c)"),
    "freight": cents("sum(freight_c)"),
    "score": half_up("sum(score_c)", "count(score_c)", 2, 100),
    "late_days": half_up("sum(late_md) FILTER (WHERE is_late)", "count(*) FILTER (WHERE is_late)", 3, 1000),
    "share": half_up("sum(freight_c)", "sum(goods_c + freight_c)", 5),
    "per_order": half_up("sum(goods_c)", "count(order_id)", 2, 100),
    "freight_per_order": half_up("sum(freight_c)", "count(order_id)", 2, 100),
    "delivery_days": half_up("sum(delivery_md)", "count(delivery_md)", 3, 1000),
    "done_days": half_up("sum(delivery_md) FILTER (WHERE order_status = 'delivered')",
                         "count(delivery_md) FILTER (WHERE order_status = 'delivered')", 3, 1000),
    "late_score": half_up("sum(score_c) FILTER (WHERE is_late)", "count(score_c) FILTER (WHERE is_late)", 2, 100),
    "time_score": half_up("sum(score_c) FILTER (WHERE NOT is_late)",
                          "count(score_c) FILTER (WHERE NOT is_late)", 2, 100),
}
F["rate"] = half_up("count(*) FILTER (WHERE is_late)", "count(is_late)", 5)

for _key, _col, _mart in (("seller", "seller_id", "m_sellers"), ("category", "category", "m_categories")):
    SQL[f"mart_{_key}_performance_monthly"] = f"""SELECT CAST(date_trunc('month', purchased_at) AS DATE) AS month,
        {_col}, {F['orders']} AS order_count, {F['gmv']} AS item_value, {F['freight']} AS freight_value,
        {F['eligible']} AS eligible_delivery_count, {F['late']} AS late_order_count, {F['rate']} AS late_rate,
        {F['late_days']} AS avg_late_days, {F['score']} AS avg_review_score FROM {_mart} GROUP BY 1, 2"""

# --- metrics ---------------------------------------------------------------------------------------
FRESH = "(SELECT CAST(max(purchased_at) AS DATE) FROM m_orders) AS data_freshness"
NONE = "CAST(NULL AS BIGINT)"
SQL["data_freshness"] = "SELECT CAST(max(purchased_at) AS DATE) AS data_freshness FROM m_orders"


def _summary(name: str, value: str, numerator: str = NONE, denominator: str = NONE) -> None:
    SQL[f"{name}_summary"] = (
        f"SELECT {value} AS value, {numerator} AS numerator, {denominator} AS denominator, {FRESH} FROM r_{name}"
    )


def _metric(name: str, sql: str) -> None:
    CTE[f"r_{name}"] = sql
    SQL[name] = f"SELECT * FROM r_{name}"


_metric("sales_summary", f"""SELECT {F['orders']} AS order_count, {F['gmv']} AS gmv_proxy,
    {F['per_order']} AS avg_order_value, {F['share']} AS freight_share, {F['score']} AS avg_review_score
    FROM m_orders WHERE {RANGE} {DONE}""")
_summary("sales_summary", "max(gmv_proxy)", denominator="max(order_count)")

CTE["by_status"] = f"""SELECT coalesce(order_status, 'unknown') AS order_status, {F['orders']} AS order_count,
    {F['gmv']} AS item_value, {F['freight']} AS freight_value, {F['score']} AS avg_review_score
    FROM m_orders WHERE {RANGE} GROUP BY 1"""
_metric("operations_overview", f"""SELECT order_status, order_count,
    {half_up('order_count', '(SELECT sum(order_count) FROM by_status)', 5)} AS order_share, item_value, freight_value,
    avg_review_score FROM by_status""")
_summary("operations_overview", "CAST(coalesce(sum(order_count), 0) AS BIGINT)",
         "CAST(coalesce(sum(order_count) FILTER (WHERE order_status IN ('canceled', 'unavailable')), 0) AS BIGINT)",
         "CAST(coalesce(sum(order_count), 0) AS BIGINT)")

_metric("monthly_trend", f"""SELECT CAST(date_trunc('month', purchased_at) AS DATE) AS month,
    {F['orders']} AS order_count, {F['done']} AS delivered_order_count, {F['gmv']} AS gmv_proxy,
    {F['freight']} AS freight_value, {F['eligible']} AS eligible_delivery_count, {F['late']} AS late_order_count,
    {F['rate']} AS late_rate, {F['done_days']} AS avg_delivery_days, {F['score']} AS avg_review_score
    FROM m_orders WHERE {RANGE} GROUP BY 1""")
_summary("monthly_trend", "count(*)", denominator="CAST(coalesce(sum(order_count), 0) AS BIGINT)")

_metric("geography_performance", f"""SELECT * FROM (SELECT coalesce(customer_state, 'unknown') AS customer_state,
    {F['orders']} AS order_count, {F['eligible']} AS eligible_delivery_count, {F['late']} AS late_order_count,
    {F['rate']} AS late_rate, {F['late_days']} AS avg_late_days, {F['delivery_days']} AS avg_delivery_days,
    {F['score']} AS avg_review_score, {F['gmv']} AS gmv_proxy FROM m_orders WHERE {RANGE} {DONE} GROUP BY 1)
    WHERE order_count >= 20 ORDER BY late_rate DESC NULLS LAST, order_count DESC, customer_state LIMIT 100""")
_summary("geography_performance", "count(*)", denominator="CAST(coalesce(sum(order_count), 0) AS BIGINT)")

for _name, _mart, _key, _least in (
    ("overall", "m_orders", "'overall' AS group_key", 1),
    ("state", "m_orders", "coalesce(customer_state, 'unknown') AS customer_state", 20),
    ("category", "m_categories", "category", 20),
):
    _alias = _key.split(" AS ")[-1]
    _metric(f"freight_analysis_{_name}", f"""SELECT * FROM (SELECT {_key}, {F['orders']} AS order_count,
        {F['gmv']} AS item_value, {F['freight']} AS freight_value, {F['share']} AS freight_share,
        {F['freight_per_order']} AS avg_freight_per_order, {F['score']} AS avg_review_score, {F['rate']} AS late_rate
        FROM {_mart} WHERE {RANGE} {DONE} GROUP BY 1) WHERE order_count >= {_least}
        ORDER BY freight_share DESC NULLS LAST, order_count DESC, {_alias} LIMIT 100""")
_summary("freight_analysis_overall", "max(freight_share)", denominator="max(order_count)")
_summary("freight_analysis_category", "CAST(NULL AS DOUBLE)", denominator=f"max({NONE})")
SQL["freight_analysis_category_summary"] = f"""SELECT CAST(NULL AS DOUBLE) AS value, {NONE} AS numerator,
    {NONE} AS denominator, {FRESH}"""

CTE["by_type"] = f"""SELECT payment_type, {F['orders']} AS participating_order_count, sum(paid_c) AS paid,
    {half_up('sum(most)', 'count(most)', 2)} AS avg_max_installments,
    {half_up('sum(n)', 'count(n)', 2)} AS avg_payment_sequences FROM m_payments WHERE {RANGE} GROUP BY 1"""
_metric("payment_analysis", f"""SELECT payment_type, participating_order_count, {cents('paid')} AS payment_value,
    {half_up('paid', '(SELECT sum(paid) FROM by_type)', 5)} AS payment_value_share, avg_max_installments,
    avg_payment_sequences FROM by_type ORDER BY paid DESC NULLS FIRST, payment_type LIMIT 20""")
SQL["payment_analysis_summary"] = f"""SELECT
    (SELECT payment_type FROM r_payment_analysis ORDER BY payment_value DESC NULLS FIRST, payment_type LIMIT 1) AS value,
    {NONE} AS numerator, count(DISTINCT order_id) AS denominator, {FRESH} FROM m_payments WHERE {RANGE}"""

for _name, _mart, _key, _least in (
    ("overall", "m_orders", "'overall' AS group_key", 1),
    ("seller", "m_sellers", "seller_id", 20),
    ("category", "m_categories", "category", 20),
):
    _alias = _key.split(" AS ")[-1]
    _metric(f"delivery_performance_{_name}", f"""SELECT * FROM (SELECT {_key}, {F['orders']} AS order_count,
        {F['eligible']} AS eligible_delivery_count, {F['late']} AS late_order_count, {F['rate']} AS late_rate,
        {F['late_days']} AS avg_late_days, {F['late_score']} AS late_avg_review_score,
        {F['time_score']} AS on_time_avg_review_score
        FROM {_mart} WHERE {RANGE} {DONE} GROUP BY 1) WHERE order_count >= {_least}
        ORDER BY late_rate DESC NULLS LAST, order_count DESC, {_alias} LIMIT 100""")
_summary("delivery_performance_overall", "max(late_rate)", "max(late_order_count)", "max(eligible_delivery_count)")

_metric("late_vs_on_time_reviews", f"""SELECT CASE WHEN is_late THEN 'late' ELSE 'on_time' END AS delivery_group,
    {F['orders']} AS reviewed_order_count, {F['score']} AS avg_review_score,
    {half_up('sum(late_md)', 'count(*)', 3, 1000)} AS avg_late_days
    FROM m_orders WHERE {RANGE} {DONE} AND is_late IS NOT NULL AND score_c IS NOT NULL GROUP BY 1""")
_summary("late_vs_on_time_reviews", """round(max(avg_review_score) FILTER (WHERE delivery_group = 'late')
    - max(avg_review_score) FILTER (WHERE delivery_group = 'on_time'), 3)""",
         denominator="CAST(coalesce(sum(reviewed_order_count), 0) AS BIGINT)")

CTE["peer"] = f"""SELECT round(avg(rate), 5) AS baseline_late_rate, round(avg(score), 2) AS baseline_review_score
    FROM (SELECT count(*) FILTER (WHERE is_late) / nullif(CAST(count(is_late) AS DOUBLE), 0) AS rate,
            sum(score_c) / 100.0 / nullif(count(score_c), 0) AS score
          FROM m_sellers WHERE {RANGE} GROUP BY seller_id HAVING count(order_id) >= 5)"""
_metric("seller_diagnostic_all", f"""SELECT t.*, peer.* FROM (SELECT seller_id, {F['orders']} AS order_count,
    {F['gmv']} AS item_value, {F['per_order']} AS avg_order_value, {F['share']} AS freight_share,
    {F['rate']} AS late_rate, {F['score']} AS avg_review_score FROM m_sellers WHERE {RANGE} GROUP BY 1) t
    CROSS JOIN peer""")
_metric("seller_diagnostic", "SELECT * FROM r_seller_diagnostic_all WHERE seller_id = 34")
_summary("seller_diagnostic", "max(late_rate)", denominator="max(order_count)")

for _name, _more in (("", ""), ("_late", "AND is_late"), ("_on_time", "AND NOT is_late")):
    _metric(f"review_samples{_name}", f"""SELECT review_id, order_id, review_score, is_late,
        {DAYS.format('late_md')} AS late_days,
        left(regexp_replace(review_comment_message, '[\\n\\r\\t]+', ' ', 'g'), 280) AS comment_excerpt
        FROM m_reviews WHERE {RANGE} AND review_score <= 2 AND review_comment_message IS NOT NULL {_more}
        ORDER BY review_score, review_created_at DESC NULLS FIRST, review_id, order_id LIMIT 100""")
_summary("review_samples", "count(*)", denominator="count(*)")




# --- quality checks --------------------------------------------------------------------------------
TABLE_OF = {"orders": "x_orders", "order_items": "x_items", "reviews": "x_reviews", "customers": "x_customers",
            "products": "x_products", "sellers": "x_sellers"}
CTE["q_row_counts"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS value FROM {t}" for name, t in TABLE_OF.items()
)
CTE["q_key_integrity"] = " UNION ALL ".join(
    [f"SELECT 'duplicate_{n}_ids' AS check_name, count(*) - count(DISTINCT {n}_id) AS value FROM {t}"
     for n, t in (("order", "x_orders"), ("customer", "x_customers"), ("product", "x_products"),
                  ("seller", "x_sellers"), ("review", "x_reviews"))]
    + [f"SELECT '{n}', count(*) FROM {c} AS c WHERE NOT EXISTS (SELECT 1 FROM {p} AS p WHERE p.{k} = c.{k})"
       for n, c, p, k in (("orphan_order_items", "x_items", "x_orders", "order_id"),
                          ("orphan_reviews", "x_reviews", "x_orders", "order_id"),
                          ("orphan_customer_orders", "x_orders", "x_customers", "customer_id"))]
)
CTE["q_time_quality"] = " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, count(*) AS value FROM x_orders WHERE {w}" for n, w in (
        ("approved_before_purchase", "approved_at < purchased_at"),
        ("delivered_before_carrier", "delivered_at < carrier_at"),
        ("cancelled_with_delivery_date",
         "(order_status = 'canceled' OR order_status = 'unavailable') AND delivered_at IS NOT NULL"),
        ("delivered_missing_actual_date", "order_status = 'delivered' AND delivered_at IS NULL"),
    )
)
CTE["q_missingness"] = " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE {w}) AS missing, count(*) AS total FROM {t}"
    for n, w, t in (
        ("product_category_missing", "product_category_name IS NULL", "x_products"),
        ("product_weight_missing", "p_partkey % 40 = 0", "x_products"),
        ("review_message_missing", "coalesce(review_comment_message, '') = ''", "x_reviews"),
    )
)
CTE["q_aggregation_risk"] = """SELECT 'multi_item_orders' AS check_name, count(*) AS value FROM o_items WHERE item_count > 1
    UNION ALL SELECT 'multi_seller_orders', count(*) FROM o_items WHERE seller_count > 1
    UNION ALL SELECT 'payment_vs_items_abs_diff_over_1', count(*) FROM x_orders o
      LEFT JOIN o_payments p ON o.order_id = p.order_id LEFT JOIN o_items i ON o.order_id = i.order_id
      WHERE abs(coalesce(p.paid_c, 0) - coalesce(i.goods_c + i.freight_c, 0)) > 100"""
for _suite in ("row_counts", "key_integrity", "time_quality", "missingness", "aggregation_risk"):
    SQL[f"dq_{_suite}"] = f"SELECT * FROM q_{_suite}"
SQL["dq_report"] = f"""
    SELECT 'row_counts' AS suite, table_name AS check_name, value, {NONE} AS total FROM q_row_counts
    UNION ALL SELECT 'key_integrity', check_name, value, {NONE} FROM q_key_integrity
    UNION ALL SELECT 'time_quality', check_name, value, {NONE} FROM q_time_quality
    UNION ALL SELECT 'missingness', check_name, missing, total FROM q_missingness
    UNION ALL SELECT 'aggregation_risk', check_name, value, {NONE} FROM q_aggregation_risk"""

_LAYERS = [("raw", "customers", "x_customers"), ("raw", "geolocation", "x_customers"), ("raw", "orders", "x_orders"),
           ("raw", "order_items", "x_items"), ("raw", "order_payments", "x_payments"),
           ("raw", "order_reviews", "x_reviews"), ("raw", "products", "part"), ("raw", "sellers", "x_sellers"),
           ("raw", "category_translation", "x_translation"),
           ("mart", "mart_order_fulfillment", "m_orders"), ("mart", "mart_seller_order_fulfillment", "m_sellers"),
           ("mart", "mart_category_order_fulfillment", "m_categories"),
           ("mart", "mart_review_analysis_base", "m_reviews"), ("mart", "mart_payment_analysis_base", "m_payments"),
           ("mart", "mart_seller_performance_monthly",
            "(SELECT DISTINCT date_trunc('month', purchased_at) AS m, seller_id FROM m_sellers)"),
           ("mart", "mart_category_performance_monthly",
            "(SELECT DISTINCT date_trunc('month', purchased_at) AS m, category FROM m_categories)")]
SQL["layer_row_counts"] = " UNION ALL ".join(
    ["""SELECT 'date_range' AS layer, 'purchased_at' AS table_name, CAST(NULL AS BIGINT) AS row_count,
        CAST(min(purchased_at) AS DATE) AS start_date, CAST(max(purchased_at) AS DATE) AS end_date FROM x_orders"""]
    + [f"SELECT '{a}', '{b}', count(*), CAST(NULL AS DATE), CAST(NULL AS DATE) FROM {c}" for a, b, c in _LAYERS]
)
SQL["read_raw_csv"] = SQL["stg_reviews"]
SQL["load_raw"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {t}" for layer, name, t in _LAYERS if layer == "raw"
)
SQL["refresh_marts"] = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {t}" for layer, name, t in _LAYERS if layer == "mart"
)
SQL["write_metric_report"] = SQL["dq_report"]
_GRAINS = (
    ("mart_order_fulfillment", "order_id", "m_orders"),
    ("mart_seller_order_fulfillment", "order_id, seller_id", "m_sellers"),
    ("mart_category_order_fulfillment", "order_id, category", "m_categories"),
    ("mart_payment_analysis_base", "order_id, payment_type", None),
    ("mart_seller_performance_monthly", "month, seller_id", None),
    ("mart_category_performance_monthly", "month, category", None),
    ("planted", "order_id", "(SELECT order_id FROM m_orders UNION ALL SELECT order_id FROM m_orders WHERE CAST(order_id AS BIGINT) % 500 = 0)"),
)
SQL["assert_unique"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS mart, NOT EXISTS (SELECT 1 FROM {source or f'({SQL[name]})'} GROUP BY {keys} HAVING count(*) > 1) AS is_unique"""
    for name, keys, source in _GRAINS
)


def all_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in SQL.items()}
