from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from parcelmart.plans import request_batch as b


def test_spans_fill_a_range_exactly(spark):
    pairs = spark.createDataFrame([(i, j) for i in range(1, 40) for j in range(i, 41)], "first int, last int")
    for row in pairs.select("first", "last", b._filling_spans(F.col("first"), F.col("last")).alias("spans")).collect():
        filled = [x for s in row.spans for x in range(s.span << s.level, (s.span + 1) << s.level)]
        assert sorted(filled) == list(range(row.first, row.last))
        assert len(row.spans) <= 2 * max(1, (row.last - row.first).bit_length())


def test_running_totals_give_the_sums_of_any_ranges(spark):
    """Ranges before, after and within the data, one-day and reversed ones; a key is in a range only with rows in it."""
    rng = random.Random(3)
    day = lambda n: dt.date(2018, 1, 1) + dt.timedelta(days=n)
    orders = [(f"o{i}", rng.choice("abc"), day(rng.choice([3, 4, 10, 40, 41, 90])), rng.choice([None, i])) for i in range(60)]
    mart = spark.createDataFrame(orders, "order_id string, k string, purchased_at date, item_value int").withColumns(
        {"item_value": F.col("item_value").cast("decimal(14,2)"), "freight_value": F.lit(None).cast("decimal(14,2)")})
    ranges = [(day(a), day(z)) for a, z in [(0, 100), (3, 3), (4, 10), (11, 39), (41, 90), (-50, -1), (91, 99), (10, 4), (0, 3), (90, 400)]]
    calls = spark.createDataFrame(ranges * 2, "start_date date, end_date date")
    found = b._range_sums(calls, mart, [F.col("k")], ["k"], ["order_count", "item_value", "freight_value"])
    got = {(r.start_date, r.end_date, r.k): (r.orders, r.goods, r.freight) for r in found.collect()}
    wanted = {}
    for start, end in ranges:
        for key in "abc":
            some = [o for o in orders if o[1] == key and start <= o[2] <= end]
            if some:
                values = [o[3] for o in some if o[3] is not None]
                wanted[start, end, key] = (len(some), sum(values) if values else None, None)
    assert got == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "CartesianProduct" not in plan


def test_a_mart_is_summed_per_edge_and_not_per_day(spark):
    mart = spark.range(400).select(
        F.col("id").alias("order_id"), F.date_add(F.lit("2018-01-01").cast("date"), F.col("id").cast("int")).alias("purchased_at"),
        (F.col("id") % 2).alias("k"))
    calls = spark.createDataFrame([(dt.date(2018, 2, 1), dt.date(2018, 12, 31))], "start_date date, end_date date")
    found = b._range_sums(calls, mart, [F.col("k")], ["k"], ["order_count"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\], functions=\[partial_", plan)
    of_keys = [k for k in keys if "k#" in k]
    assert len(of_keys) == 2 and all("edge_no" in k or "start_date" in k for k in of_keys)
    assert sorted((r.k, r.orders) for r in found.collect()) == [(0, 167), (1, 167)]
