"""All metric calls of a whole table of requests in one job.

Requests share ranges, so each distinct range is computed once. The first days of all ranges and the days after their last
are the edges. A mart is summed per key and the edge that follows the day, and added up along the edges to running totals; a range is
the total at its last edge less the one at its first, two rows met by equality. Rows that don't add up (the best reviews of a range)
are ranked once in spans of 1, 2, 4, ... neighbouring edges, and a range is put together from the few spans that fill it. No range
unfolds into days, and no request is compared with the orders themselves.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmart.functions.numbers import decimals_to_double, ratio
from parcelmart.functions.timing import month_of
from parcelmart.operators import measures, metrics
from parcelmart.plans.warehouse import Marts

RANGE = ["start_date", "end_date"]
SPAN = ["level", "span"]


@dataclass(frozen=True)
class Call:
    """One metric call of a plan: position, step, metric and fixed parameters."""

    call_no: int
    family: str
    metric_name: str
    top_k: int | None = None
    uses_min_orders: bool = False


# Metric calls per intent, in order.
CALLS: dict[str, tuple[Call, ...]] = {
    "delivery_analysis": (
        Call(1, "delivery_seller", "late_delivery_rate", 10, True),
        Call(2, "delivery_category", "late_delivery_rate", 10, True),
        Call(3, "review_groups", "late_vs_on_time_review_score"),
    ),
    "review_analysis": (Call(1, "review_samples", "low_score_review_samples", 20),),
    "seller_diagnostic": (Call(1, "seller", "seller_diagnostic"),),
    "sales_summary": (Call(1, "sales", "sales_summary"),),
    "operations_overview": (
        Call(1, "status", "operations_overview"), Call(2, "sales", "sales_summary"),
        Call(3, "delivery_overall", "late_delivery_rate", 1),
    ),
    "trend_analysis": (Call(1, "trend", "monthly_operations_trend"),),
    "geography_analysis": (
        Call(1, "state_delivery", "customer_state_delivery_performance", 27, True),
        Call(2, "state_freight", "freight_cost_structure", 27, True),
    ),
    "freight_analysis": (
        Call(1, "freight_overall", "freight_cost_structure", 1),
        Call(2, "freight_category", "freight_cost_structure", 10, True),
    ),
    "payment_analysis": (Call(1, "payment", "payment_method_mix", 10),),
    "mixed": (Call(1, "delivery_overall", "late_delivery_rate", 1),),
}
MAX_SCORE = 2
MAX_LEVEL = 24  # spans of up to 2^24 edges: more than there are days


def _calls_of(requests: DataFrame, family: str) -> DataFrame:
    """Requests that make a call of this family: request_id, call_no, range, minimum, seller."""
    numbers = {i: c.call_no for i, calls in CALLS.items() for c in calls if c.family == family}
    call_no = F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair])
    return requests.filter(F.col("intent").isin(*numbers) & F.col("usable")).select(
        "request_id", F.element_at(call_no, F.col("intent")).alias("call_no"), *RANGE, "min_orders", "seller_id"
    )


def _parameters(family: str) -> Call:
    return next(c for calls in CALLS.values() for c in calls if c.family == family)


def _edges(calls: DataFrame) -> DataFrame:
    """(edge, edge_no): the days where a range starts or has just ended, numbered from 1. At most as many as there are days."""
    ranges = calls.select(*RANGE).distinct().where("start_date <= end_date")
    edges = ranges.select(F.explode(F.array("start_date", F.date_add("end_date", 1))).alias("edge")).distinct()
    return edges.withColumn("edge_no", F.row_number().over(Window.orderBy("edge")))


def _numbered(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ranges with the numbers of their edges."""
    ranges = calls.select(*RANGE).distinct()
    return ranges.join(edges.select(F.col("edge").alias("start_date"), F.col("edge_no").alias("first_no")), "start_date").join(
        edges.select(F.date_sub("edge", 1).alias("end_date"), F.col("edge_no").alias("last_no")), "end_date")


def _edge_of_day(days: DataFrame, edges: DataFrame) -> DataFrame:
    """(bucket, edge_no): the first edge after each day; days after the last edge are in no range. One row per day of the calendar."""
    marks = days.select("bucket", F.lit(None).cast("int").alias("edge_no")).unionByName(
        edges.select(F.col("edge").alias("bucket"), "edge_no"))
    later = Window.orderBy(F.desc("bucket"), F.asc_nulls_first("edge_no")).rowsBetween(Window.unboundedPreceding, 0)
    following = marks.select("bucket", F.last("edge_no", ignorenulls=True).over(later).alias("following"), F.col("edge_no").isNull().alias("is_day"))
    return following.where("is_day AND following IS NOT NULL").select("bucket", F.col("following").alias("edge_no"))


def _running_totals(mart: DataFrame, edges: DataFrame, keys: list[Column], names: list[str], columns: list[str]) -> DataFrame:
    """(names, edge_no, n_rows, and per measure its total and the edges that have one) at every edge from a key's first day on.

    The edge of each day goes to the rows themselves (one row per day of the calendar, broadcast), so a mart is summed per key and edge at
    once and not per key and day before.
    """
    dated = mart.withColumn("bucket", F.col("purchased_at").cast("date"))
    edge_of_day = F.broadcast(_edge_of_day(dated.select("bucket").distinct(), edges))
    summed = measures.summed(dated.join(edge_of_day, "bucket"), [F.col("edge_no"), *keys], columns)
    parts = [F.lit(1).cast("bigint").alias("n_rows")]
    for m in measures.needed(columns):
        parts += [F.coalesce(m, F.lit(0)).alias(m), F.col(m).isNotNull().cast("bigint").alias(f"{m}_edges")]
    per_edge = summed.select(*names, "edge_no", *parts)
    so_far = Window.partitionBy(*names).orderBy("edge_no")
    totals = [c for c in per_edge.columns if c not in (*names, "edge_no")]
    last = edges.agg(F.max("edge_no")).scalar()
    running = per_edge.select(*names, "edge_no", F.lead("edge_no").over(so_far).alias("next_no"), *[
        F.sum(c).over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in totals])
    until = F.coalesce(F.col("next_no") - 1, last)
    return running.select(*names, F.explode(F.sequence("edge_no", until)).alias("edge_no"), *totals)


def _range_sums(calls: DataFrame, mart: DataFrame, keys: list[Column], names: list[str], columns: list[str]) -> DataFrame:
    """Sums of each distinct range and key that has rows in it."""
    edges = _edges(calls)
    running = _running_totals(mart, edges, keys, names, columns)
    signed = _numbered(calls, edges).select(*RANGE, F.explode(F.array(
        F.struct(F.col("last_no").alias("edge_no"), F.lit(1).alias("sign")),
        F.struct(F.col("first_no").alias("edge_no"), F.lit(-1).alias("sign")))).alias("e")).select(*RANGE, "e.*")
    totals = [c for c in running.columns if c not in (*names, "edge_no")]
    sums = running.join(signed, "edge_no").groupBy(*RANGE, *names).agg(*[
        F.sum(F.when(F.col("sign") > 0, F.col(c)).otherwise(-F.col(c))).alias(c) for c in totals])
    return sums.where("n_rows > 0").select(*RANGE, *names, *[
        measures.narrowed(m, F.when(F.col(f"{m}_edges") > 0, F.col(m))).alias(m) for m in measures.needed(columns)])


def _top(rows: DataFrame, calls: DataFrame, family: str, order: list[Column]) -> DataFrame:
    """Rows of a range -> ranked rows of each request, after its minimum of orders and its limit."""
    call = _parameters(family)
    by = [*RANGE, "min_orders"] if call.uses_min_orders else RANGE
    wanted = calls.select(*by).distinct()
    count = next((c for c in ("order_count", "participating_order_count") if c in rows.columns), None)
    matched = rows.join(wanted, RANGE)
    if call.uses_min_orders:
        matched = matched.filter(F.col(count) >= F.col("min_orders"))
    ranked = matched.withColumn("row_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if call.top_k:
        ranked = ranked.filter(F.col("row_rank") <= call.top_k)
    return decimals_to_double(_to_requests(calls, ranked, by))


def _to_requests(calls: DataFrame, rows: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Hands the few rows of a call to all requests that make it. Most requests may share one range: their side is a scan, so the join
    can be split."""
    out = calls.select("request_id", "call_no", *by).join(rows, by, how)
    return out.drop(*[c for c in by if c != "seller_id"])


def _grouped(
    marts: Marts, requests: DataFrame, family: str, mart: DataFrame, key: Column, name: str, columns: list[str],
    order: list[Column], delivered: bool = True, share: tuple[str, str, str] | None = None,
) -> DataFrame:
    calls = _calls_of(requests, family)
    source = mart.filter(F.col("order_status") == measures.DELIVERED) if delivered else mart
    sums = _range_sums(calls, source, [key.alias(name)], [name], columns)
    rows = sums.select(*RANGE, name, *measures.formulas(columns))
    if share:
        value, target, dtype = share
        total = F.sum(value).over(Window.partitionBy(*RANGE))
        rows = rows.withColumn(target, ratio(F.col(value).cast(dtype), total, 10, 5))
    return _top(rows, calls, family, order)


def _late_first(name: str) -> list[Column]:
    return [F.desc_nulls_last("late_rate"), F.desc("order_count"), F.asc(name)]


def _freight_first(name: str) -> list[Column]:
    return [F.desc_nulls_last("freight_share"), F.desc("order_count"), F.asc(name)]


def _sales(marts: Marts, requests: DataFrame) -> DataFrame:
    """Always one row per request: a range without orders has a count of 0 and no values."""
    calls = _calls_of(requests, "sales")
    done = marts.orders.filter(F.col("order_status") == measures.DELIVERED)
    sums = _range_sums(calls, done, [], [], metrics.SALES_COLUMNS)
    rows = sums.select(*RANGE, *measures.formulas(metrics.SALES_COLUMNS))
    out = _to_requests(calls, rows, RANGE, "left")
    return decimals_to_double(out.withColumn("order_count", F.coalesce("order_count", F.lit(0))))


def _trend(marts: Marts, requests: DataFrame) -> DataFrame:
    calls = _calls_of(requests, "trend")
    month = month_of("purchased_at").alias("month")
    sums = _range_sums(calls, marts.orders, [month], ["month"], metrics.TREND_COLUMNS)
    rows = sums.select(*RANGE, "month", *measures.formulas(metrics.TREND_COLUMNS))
    return _top(rows, calls, "trend", [F.asc("month")])


def _review_groups(marts: Marts, requests: DataFrame) -> DataFrame:
    calls = _calls_of(requests, "review_groups")
    known = marts.orders.filter(
        (F.col("order_status") == measures.DELIVERED) & F.col("is_late").isNotNull() & F.col("review_score").isNotNull()
    )
    group = F.when(F.col("is_late"), F.lit("late")).otherwise(F.lit("on_time")).alias("delivery_group")
    columns = metrics.REVIEW_GROUP_COLUMNS
    sums = _range_sums(calls, known, [group], ["delivery_group"], columns)
    rows = sums.select(*RANGE, "delivery_group", *measures.formulas(columns))
    return _top(rows, calls, "review_groups", [F.asc("delivery_group")])


def _seller(marts: Marts, requests: DataFrame) -> DataFrame:
    calls = _calls_of(requests, "seller")
    columns = metrics.SELLER_COLUMNS
    per_seller = _range_sums(calls, marts.seller_orders, [F.col("seller_id")], ["seller_id"], columns)
    baseline = metrics.peer_baseline(per_seller, RANGE)
    targets = calls.select(*RANGE, "seller_id").distinct()
    rows = per_seller.join(targets, [*RANGE, "seller_id"]).select(
        *RANGE, "seller_id", *measures.formulas(columns)
    ).join(baseline, RANGE, "left")
    return decimals_to_double(_to_requests(calls, rows, [*RANGE, "seller_id"]))


def _filling_spans(first: Column, last: Column) -> Column:
    """The spans that fill the edges from ``first`` to before ``last``: at most two of each level."""
    def step(acc: Column, level: Column) -> Column:
        left, right = acc["left"], acc["right"]
        odd_left, odd_right = (left < right) & (left % 2 == 1), (left < right) & (right % 2 == 1)
        span = lambda at: F.array(F.struct(level.alias("level"), at.alias("span")))
        none = F.array().cast("array<struct<level:int,span:int>>")
        after = F.when(odd_left, left + 1).otherwise(left)
        before = F.when(odd_right, right - 1).otherwise(right)
        return F.struct(F.shiftright(after, 1).alias("left"), F.shiftright(before, 1).alias("right"), F.concat(
            acc["spans"], F.when(odd_left, span(left)).otherwise(none), F.when(odd_right & (after <= before), span(before)).otherwise(none)
        ).alias("spans"))

    start = F.struct(first.alias("left"), last.alias("right"), F.array().cast("array<struct<level:int,span:int>>").alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_LEVEL)), start, step, lambda acc: acc["spans"])


def _review_samples(marts: Marts, requests: DataFrame) -> DataFrame:
    """Best rows per range come from the best rows of the spans that fill it, so a range never meets all reviews."""
    call = _parameters("review_samples")
    calls = _calls_of(requests, "review_samples")
    low = marts.reviews.filter(
        (F.col("review_score") <= MAX_SCORE) & F.col("review_comment_message").isNotNull()
    )
    order = [
        F.asc("review_score"), F.desc_nulls_first("review_created_at"), F.asc("review_id"), F.asc("order_id"),
    ]

    def best(df: DataFrame, by: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn("row_rank", rank).filter(F.col("row_rank") <= call.top_k)

    samples = low.select(
        F.col("purchased_at").cast("date").alias("bucket"), "review_id", "order_id", "review_score",
        "review_created_at", "is_late", "late_days",
        metrics.review_excerpt("review_comment_message").alias("comment_excerpt"),
    )
    edges = _edges(calls)
    of_edge = best(best(samples, ["bucket"]).drop("row_rank").join(_edge_of_day(samples.select("bucket").distinct(), edges), "bucket"),
                   ["edge_no"]).drop("row_rank", "bucket")
    levels = F.ceil(F.log2(edges.agg(F.max("edge_no")).scalar() + 1)).cast("int")
    of_span = best(of_edge.withColumn("level", F.explode(F.sequence(F.lit(0), levels))).withColumn(
        "span", F.expr("shiftright(edge_no, level)")).drop("edge_no"), SPAN).drop("row_rank")
    filled = _numbered(calls, edges).select(
        *RANGE, F.inline(_filling_spans(F.col("first_no") + 1, F.col("last_no") + 1)))
    rows = best(of_span.join(filled, SPAN), RANGE)
    return decimals_to_double(_to_requests(calls, rows, RANGE).drop(*SPAN, "review_created_at"))


def run_plan(marts: Marts, requests: DataFrame, families: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Rows of every metric call of all usable requests, one frame per call family (or the named ones).

    ``requests`` comes from ``operators.requests.route_intent``.
    """
    m, overall = metrics, F.lit("overall")
    state = F.coalesce("customer_state", F.lit("unknown"))
    status = F.coalesce("order_status", F.lit("unknown"))
    orders, sellers, categories = marts.orders, marts.seller_orders, marts.category_orders
    by_status = [F.desc("order_count"), F.asc("order_status")]
    by_value = [F.desc_nulls_first("payment_value"), F.asc("payment_type")]

    # family -> mart, key, key name, columns, order, and for shares: whole mart, (value, share, type)
    grouped = {
        "status": (orders, status, "order_status", m.OVERVIEW_COLUMNS, by_status, False,
                   ("order_count", "order_share", "decimal(20,0)")),
        "payment": (marts.payments, F.col("payment_type"), "payment_type", m.PAYMENT_COLUMNS, by_value, False,
                    ("payment_value", "payment_value_share", "decimal(16,2)")),
        "state_delivery": (orders, state, "customer_state", m.GEOGRAPHY_COLUMNS, _late_first("customer_state")),
        "state_freight": (orders, state, "customer_state", m.FREIGHT_COLUMNS, _freight_first("customer_state")),
        "freight_overall": (orders, overall, "group_key", m.FREIGHT_COLUMNS, _freight_first("group_key")),
        "freight_category": (categories, F.col("category"), "category", m.FREIGHT_COLUMNS, _freight_first("category")),
        "delivery_overall": (orders, overall, "group_key", m.DELIVERY_COLUMNS, _late_first("group_key")),
        "delivery_seller": (sellers, F.col("seller_id"), "seller_id", m.DELIVERY_COLUMNS, _late_first("seller_id")),
        "delivery_category": (categories, F.col("category"), "category", m.DELIVERY_COLUMNS, _late_first("category")),
    }
    single = {
        "sales": _sales, "trend": _trend, "review_groups": _review_groups, "review_samples": _review_samples,
        "seller": _seller,
    }
    return {
        family: single[family](marts, requests) if family in single
        else _grouped(marts, requests, family, *grouped[family])
        for family in (families or [*single, *grouped])
    }


def tool_calls(requests: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """One row per metric call of a usable request: metric name and number of result rows."""
    plans = F.create_map(*[
        part for intent, calls in CALLS.items() for part in (F.lit(intent), F.array(*[
            F.struct(F.lit(c.call_no).alias("call_no"), F.lit(c.metric_name).alias("metric_name")) for c in calls
        ]))
    ])
    made = requests.filter("usable").select("request_id", F.inline(F.element_at(plans, F.col("intent"))))
    counts = reduce(DataFrame.unionByName, [df.select("request_id", "call_no") for df in results.values()])
    counted = counts.groupBy("request_id", "call_no").agg(F.count(F.lit(1)).alias("row_count"))
    return made.join(counted, ["request_id", "call_no"], "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0))
    )
