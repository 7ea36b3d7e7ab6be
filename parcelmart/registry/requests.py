"""Jobs of the request, evidence and run-log layers."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmart.functions.text import excerpt, flag_injection, redact_text
from parcelmart.operators import evidence as e
from parcelmart.operators import requests as q
from parcelmart.operators.retrieval import hybrid_search, prepare_queries
from parcelmart.operators import runlog as log
from parcelmart.plans.request_batch import CALLS, run_plan, tool_calls
from parcelmart.registry import knowledge, warehouse
from parcelmart.session import shared_folder
from parcelmart.sources import testdata as td

FAMILIES = sorted({c.family for calls in CALLS.values() for c in calls})


def routed(spark: SparkSession, folder: str) -> DataFrame:
    return q.route_intent(q.parse_requests(td.x_requests(spark, folder)))


_stored: dict[tuple[str, str], DataFrame] = {}


def stored_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Routed requests as a written table; every call family reads it several times."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        path = shared_folder(spark, f"requests-{hashlib.sha256(folder.encode()).hexdigest()[:12]}")
        routed(spark, folder).write.mode("overwrite").parquet(path)
        _stored[key] = spark.read.parquet(path)
    return _stored[key]


def plan_results(spark: SparkSession, folder: str, *families: str) -> dict[str, DataFrame]:
    marts = warehouse.stored_marts(spark, folder)
    hashed = replace(marts, seller_orders=marts.seller_orders.withColumn("seller_id", td.hashed_seller()))
    return run_plan(hashed, stored_requests(spark, folder), families or None)


def calls(spark: SparkSession, folder: str) -> DataFrame:
    return tool_calls(stored_requests(spark, folder), plan_results(spark, folder))


def retrieved(spark: SparkSession, folder: str) -> DataFrame:
    """What each request's own text finds in the corpus; sales summaries and unusable requests ask nothing."""
    asking = stored_requests(spark, folder).filter("usable AND intent <> 'sales_summary'")
    queries = prepare_queries(asking.select(F.col("request_id").alias("query_id"), "query"), kind=knowledge.CHECKED_DIGEST)
    found = hybrid_search(knowledge.index(spark, folder), queries, 5)
    return e.redact_injected_chunks(found).withColumnRenamed("query_id", "request_id")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """The composed job: metrics, retrieval, redaction, gate and citations of every request, one row each."""
    requests, found = stored_requests(spark, folder), written_once(spark, folder, "retrieved", retrieved)
    gate = e.evidence_gate(requests, calls(spark, folder), found)
    cited = e.number_citations(found, "request_id", "result_rank").groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("citation", "chunk_id"))).alias("c"), F.count_if("potential_injection").alias("redacted"))
    return requests.select("request_id", "intent").join(gate, "request_id").join(cited, "request_id", "left").select(
        "request_id", "intent", F.when(F.col("evidence_status") == "failed", "failed").otherwise("completed").alias("status"),
        "evidence_status", "warning", F.coalesce("redacted", F.lit(0)).alias("redacted"),
        F.col("c").alias("citations"))


def written_once(spark: SparkSession, folder: str, name: str, make) -> DataFrame:
    """A frame of a test folder as a written table, made once per application."""
    key = (spark.sparkContext.applicationId, f"{folder}/{name}")
    if key not in _stored:
        path = shared_folder(spark, f"{name}-{hashlib.sha256(folder.encode()).hexdigest()[:12]}")
        made = make(spark, folder)
        made.write.mode("overwrite").parquet(path)
        _stored[key] = spark.read.schema(made.schema).parquet(path)
    return _stored[key]


def _step_summary(spark: SparkSession, folder: str) -> DataFrame:
    line = lambda m: F.concat_ws(":", m["metric_name"], m["row_count"].cast("string"))
    return log.analytics_step_summary(calls(spark, folder)).select(
        "request_id", F.array_join(F.transform("metrics", line), ", ").alias("metrics"), "tool_count"
    )


def _retrieval_summary(spark: SparkSession, folder: str) -> DataFrame:
    line = lambda s: F.concat_ws(
        ":", s["chunk_id"], F.coalesce(s["fts_rank"].cast("string"), F.lit("-")),
        F.coalesce(s["vector_rank"].cast("string"), F.lit("-")),
    )
    return log.retrieval_step_summary(knowledge.queries(spark, folder), knowledge._search(spark, folder)).select(
        "query_id", F.coalesce(F.array_join(F.transform("scores", line), ", "), F.lit("")).alias("scores")
    )


def _streamed(spark: SparkSession, folder: str) -> DataFrame:
    from parcelmart.streaming.event_tail import delivered, tail_events

    name = hashlib.sha256(folder.encode()).hexdigest()[:12]
    source = shared_folder(spark, f"event-log-{name}")
    td.x_events(spark, folder).withColumn("day", F.col("created_at").cast("date")).hint(
        "rebalance", "day"
    ).write.mode("overwrite").parquet(f"{source}/events")
    run = hashlib.sha256(spark.sparkContext.applicationId.encode()).hexdigest()[:8]
    target = f"{source}/out-{run}-{_next()}"
    tail_events(spark, f"{source}/events", target).awaitTermination()
    return delivered(spark, target)


_runs = iter(range(1_000_000))


def _next() -> int:
    return next(_runs)


def jobs() -> dict:
    out = {
        "parse_requests": lambda s, f: q.parse_requests(td.x_requests(s, f)).drop("query"),
        "route_intent": lambda s, f: routed(s, f).select("request_id", "intent"),
        "plan_requests": lambda s, f: q.plan_requests(routed(s, f)),
        "tool_calls": calls,
        "flag_injection": lambda s, f: td.x_flagged_texts(s, f).select(
            "doc_id", flag_injection("content").alias("flagged")
        ),
        "redact_injected_chunks": lambda s, f: e.redact_injected_chunks(td.x_flagged_texts(s, f)),
        "injection_warnings": lambda s, f: e.injection_warnings(
            e.redact_injected_chunks(td.x_flagged_texts(s, f)), "doc_id"
        ),
        "redact_text": lambda s, f: td.table(s, f, "documents").select("doc_id", redact_text("text").alias("summary")),
        "text_excerpt": lambda s, f: td.table(s, f, "documents").select("doc_id", excerpt("text", 800).alias("excerpt")),
        "evidence_gate": lambda s, f: e.evidence_gate(
            stored_requests(s, f), calls(s, f), retrieved(s, f)
        ),
        "answer_requests": lambda s, f: answers(s, f).withColumn("n_citations", F.coalesce(F.size("citations"), F.lit(0))).drop("citations"),
        "number_citations": lambda s, f: e.number_citations(knowledge._search(s, f), "query_id", "result_rank").select(
            "query_id", "chunk_id", "citation", "citation_excerpt"
        ),
        "critic_checks": lambda s, f: e.critic_checks(td.x_reports(s, f)).drop("report"),
        "compact_result": lambda s, f: e.compact_result(
            warehouse.marts(s, f).seller_monthly, ["month"], [F.desc("order_count"), F.asc("seller_id")]
        ).select("month", "row_no", "seller_id", "order_count"),
        "events_after": lambda s, f: log.events_after(td.x_events(s, f), 8, 50),
        "pages_after": lambda s, f: log.pages_after(
            td.x_events(s, f), td.x_events(s, f).groupBy("run_id").agg((F.min("sequence") + 100).alias("cursor"))
        ),
        "run_status": lambda s, f: log.run_status(td.x_events(s, f)),
        "assemble_answer": lambda s, f: log.assemble_answer(td.x_events(s, f)),
        "run_trace": lambda s, f: log.run_trace(
            log.run_status(td.x_events(s, f)), td.x_steps(s, f), td.x_tool_calls(s, f), td.x_events(s, f)
        ).withColumn("payload", F.get_json_object("detail", "$.payload")).drop("detail"),
        "session_messages": lambda s, f: log.session_messages(td.x_messages(s, f)),
        "step_summary": _step_summary,
        "retrieval_step_summary": _retrieval_summary,
        "stream_events_after": _streamed,
    }
    for family in FAMILIES:
        out[f"run_plan_{family}"] = lambda s, f, n=family: plan_results(s, f, n)[n].drop("call_no")
    return out
