"""Free-text requests -> time range, filters, intent and plan, as columns over a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns. (?U) lets \s and \b follow Unicode, so a Chinese character is a word character.
MONTH = r"(?U)(20[0-9]{2})\s*(?:年|[-/.])\s*(1[0-2]|0?[1-9])\s*(?:月)?"
DATE_PAIR = r"(?d)(20[0-9]{2}-[0-9]{2}-[0-9]{2}).{0,20}?(20[0-9]{2}-[0-9]{2}-[0-9]{2})"
SELLER = r"(?iU)\b[0-9a-f]{32}\b"
MIN_ORDERS = r"(?iU)(?:不少于|至少|min(?:imum)?\s*)\s*([0-9]+)"
DEFAULT_START, DEFAULT_END = "2016-09-01", "2018-08-31"
DEFAULT_MIN_ORDERS = 20
MIN_ORDERS_RANGE = (1, 100_000)

# The first intent one of whose words occurs in the lowered request wins.
INTENT_WORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("payment_analysis", ("支付", "付款", "信用卡", "分期", "payment", "boleto", "voucher")),
    ("geography_analysis", ("地区", "区域", "各州", "州级", "地域", "geography", "state")),
    ("freight_analysis", ("运费", "物流成本", "配送成本", "freight")),
    ("trend_analysis", ("趋势", "走势", "月度", "按月", "trend", "monthly")),
    ("operations_overview",
     ("经营总览", "运营总览", "订单状态", "取消率", "取消", "overview", "canceled", "unavailable")),
    ("delivery_analysis", ("配送", "延期", "延迟", "delivery", "late")),
    ("review_analysis", ("差评", "低分", "投诉", "review")),
    ("sales_summary", ("gmv", "销售", "客单价", "sales")),
)
SELLER_INTENT, OTHER_INTENT = "seller_diagnostic", "mixed"

# Intent -> ordered (step, metric) pairs; search_knowledge is the retrieval step.
KNOWLEDGE = ("retrieve_policy", "search_knowledge")
PLANS: dict[str, tuple[tuple[str, str], ...]] = {
    "delivery_analysis": (
        ("rank_sellers", "delivery_performance"), ("rank_categories", "delivery_performance"),
        ("compare_reviews", "late_vs_on_time_reviews"), KNOWLEDGE,
    ),
    "review_analysis": (("review_samples", "review_samples"), KNOWLEDGE),
    "seller_diagnostic": (("seller_metrics", "seller_diagnostic"), KNOWLEDGE),
    "sales_summary": (("sales_metrics", "sales_summary"),),
    "operations_overview": (
        ("status_mix", "operations_overview"), ("sales_metrics", "sales_summary"),
        ("delivery_summary", "delivery_performance"), KNOWLEDGE,
    ),
    "trend_analysis": (("monthly_trend", "monthly_trend"), KNOWLEDGE),
    "geography_analysis": (
        ("state_delivery", "geography_performance"), ("state_freight", "freight_analysis"), KNOWLEDGE,
    ),
    "freight_analysis": (
        ("overall_freight", "freight_analysis"), ("category_freight", "freight_analysis"), KNOWLEDGE,
    ),
    "payment_analysis": (("payment_mix", "payment_analysis"), KNOWLEDGE),
    "mixed": (("delivery_summary", "delivery_performance"), KNOWLEDGE),
}


def _group(text: Column, pattern: str, index: int) -> Column:
    """Group of the first match, NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def parse_requests(requests: DataFrame, query: str = "query") -> DataFrame:
    """Adds start_date, end_date, seller_id, min_orders and whether the parameters are usable.

    A pair of ISO dates gives the range, else the first year-month gives its month, else the default. An
    impossible date, an end before the start or a minimum outside its limits makes the request unusable.
    """
    text = F.trim(F.col(query))
    first, last = _group(text, DATE_PAIR, 1), _group(text, DATE_PAIR, 2)
    year, month = _group(text, MONTH, 1).cast("int"), _group(text, MONTH, 2).cast("int")
    of_month = F.make_date(year, month, F.lit(1))
    minimum = _group(text, MIN_ORDERS, 1)
    parsed = requests.withColumns({
        "start_date": F.when(first.isNotNull(), F.try_to_date(first, "yyyy-MM-dd"))
        .otherwise(F.coalesce(of_month, F.lit(DEFAULT_START).cast("date"))),
        "end_date": F.when(first.isNotNull(), F.try_to_date(last, "yyyy-MM-dd"))
        .otherwise(F.coalesce(F.last_day(of_month), F.lit(DEFAULT_END).cast("date"))),
        "seller_id": F.lower(_group(text, SELLER, 0)),
        "min_orders": F.when(minimum.isNull(), F.lit(DEFAULT_MIN_ORDERS).cast("bigint"))
        .otherwise(minimum.try_cast("bigint")),
    })
    usable = (F.col("end_date") >= F.col("start_date")) & F.col("min_orders").between(*MIN_ORDERS_RANGE)
    return parsed.withColumn("usable", F.coalesce(usable, F.lit(False)))


def route_intent(parsed: DataFrame, query: str = "query") -> DataFrame:
    lowered = F.lower(query)
    intent = F.when(F.col("seller_id").isNotNull(), F.lit(SELLER_INTENT))
    for name, words in INTENT_WORDS:
        met = F.lit(False)
        for word in words:
            met = met | F.contains(lowered, F.lit(word))
        intent = intent.when(met, F.lit(name))
    return parsed.withColumn("intent", intent.otherwise(F.lit(OTHER_INTENT)))


def plan_requests(routed: DataFrame) -> DataFrame:
    """One row per request and step, in plan order (step_no from 1)."""
    plans = F.create_map(*[
        part for intent, steps in PLANS.items() for part in (
            F.lit(intent),
            F.array(*[F.struct(F.lit(s).alias("step"), F.lit(t).alias("tool")) for s, t in steps]),
        )
    ])
    steps = routed.select("request_id", "intent", F.posexplode(F.element_at(plans, F.col("intent"))).alias("p", "s"))
    return steps.select("request_id", "intent", (F.col("p") + 1).alias("step_no"), "s.step", "s.tool")
