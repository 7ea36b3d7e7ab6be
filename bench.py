"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of test tables, BENCH_CPUS: local cores. Metrics run on refreshed marts, whose
refresh is timed as well; retrieval runs on the ingested corpus and its index, whose ingestion and writing are timed as well.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from parcelmart.functions.numbers import decimals_to_double  # noqa: E402
from parcelmart.registry import all_jobs, knowledge, requests, warehouse  # noqa: E402
from parcelmart.session import build_session  # noqa: E402

DIRECT = (
    "mart_order_fulfillment", "mart_seller_order_fulfillment", "mart_category_order_fulfillment",
    "mart_payment_analysis_base", "mart_seller_performance_monthly", "delivery_performance_seller", "dq_report",
    "layer_row_counts", "chunk_documents", "hash_embedding", "lexical_candidates", "vector_candidates",
    "hybrid_search", "retrieval_eval", "route_intent", "run_plan_delivery_seller", "run_plan_review_samples",
    "flag_injection", "critic_checks", "run_status", "assemble_answer", "stream_events_after",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus), spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}

    def timed(name, action) -> None:
        started = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - started, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    drain(spark.range(1_000_000))
    timed("refresh_marts", lambda: warehouse.stored_marts(spark, folder))
    marts = warehouse.stored_marts(spark, folder)
    for name, call in warehouse.metric_calls().items():
        timed(f"metric_{name}", lambda c=call: drain(decimals_to_double(c(marts).rows)))
    timed("ingest_knowledge", lambda: knowledge.corpus(spark, folder))
    timed("index_knowledge", lambda: knowledge.index(spark, folder))
    timed("hash_embedding_blake2b", lambda: drain(knowledge._embedding_checks(spark, folder, "blake2b")))
    timed("route_requests", lambda: requests.stored_requests(spark, folder))
    jobs = all_jobs()
    for name in DIRECT:
        timed(name, lambda n=name: drain(jobs[n](spark, folder)))
    spark.stop()
    sf = pathlib.Path(folder).name.removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
