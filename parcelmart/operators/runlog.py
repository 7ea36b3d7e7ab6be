"""Queries over the append-only run log: events, steps, tool calls, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmart.operators.joins import salted_join

PAGE = 100
TERMINAL = ("run.completed", "run.failed", "run.cancelled")
# Status a run has after an event of that type.
STATUS_AFTER = {
    "run.queued": "queued", "run.started": "running", "run.completed": "completed", "run.failed": "failed",
    "run.cancelled": "cancelled",
}
EVENT_SCHEMA = "sequence bigint, run_id bigint, event_type string, payload string, created_at timestamp_ntz"


def events_after(events: DataFrame, run_id: object, cursor: int = 0, limit: int = PAGE) -> DataFrame:
    """Next page of one run: events beyond the cursor in order."""
    beyond = (F.col("run_id") == F.lit(run_id)) & (F.col("sequence") > cursor)
    return events.filter(beyond).orderBy("sequence").limit(limit).select(
        "sequence", "event_type", "payload", "created_at"
    )


def pages_after(events: DataFrame, cursors: DataFrame, limit: int = PAGE) -> DataFrame:
    """Next page of every run of ``cursors`` (run_id, cursor).

    The events of a run are spread over salted tasks, each of which keeps a page at most.
    """
    order = Window.partitionBy("run_id").orderBy("sequence")
    beyond = salted_join(events, cursors, ["run_id"], ["sequence"]).filter(F.col("sequence") > F.col("cursor"))
    page = beyond.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    return page.select("run_id", "sequence", "event_type", "payload", "created_at")


def run_status(events: DataFrame) -> DataFrame:
    """Latest status of each run that has one."""
    known = F.create_map(*[part for e, s in STATUS_AFTER.items() for part in (F.lit(e), F.lit(s))])
    marks = events.filter(F.col("event_type").isin(*STATUS_AFTER)).select("run_id", "sequence", "event_type")
    # The status of a sequence number is unique, so the maximum over long keys finds it without text buffers.
    last = marks.groupBy("run_id").agg(F.max("sequence").alias("sequence"))
    return marks.join(last, ["run_id", "sequence"]).select(
        "run_id", F.element_at(known, F.col("event_type")).alias("status")
    )


def assemble_answer(events: DataFrame) -> DataFrame:
    """Per run the text of its assistant.delta events, joined in order.

    Pieces are joined per thousand sequence numbers first and then those pieces, so that a long run is
    spread over many tasks until its last step.
    """
    deltas = events.filter(F.col("event_type") == "assistant.delta").select(
        "run_id", "sequence", F.floor(F.col("sequence") / 1000).alias("part"),
        F.coalesce(F.get_json_object("payload", "$.content"), F.lit("")).alias("piece"),
    )
    parts = deltas.groupBy("run_id", "part").agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY sequence)").alias("piece")
    )
    return parts.groupBy("run_id").agg(F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY part)").alias("answer"))


def run_trace(runs: DataFrame, steps: DataFrame, tool_calls: DataFrame, events: DataFrame, run_id: object = None) -> DataFrame:
    """Run row, steps by id, tool calls by start and id, events by sequence: one tagged union.

    ``section`` and the order keys give the reading order, ``detail`` has all columns of the row as JSON; with
    ``run_id`` only that run is read, in that order.
    """
    def part(section: int, name: str, df: DataFrame, at: str, key: str, label: str) -> DataFrame:
        kept = df if run_id is None else df.filter(F.col("run_id") == F.lit(run_id))
        return kept.select(
            "run_id", F.lit(section).alias("section"), F.lit(name).alias("kind"),
            F.col(at).cast("timestamp_ntz").alias("order_time"), F.col(key).cast("bigint").alias("order_id"),
            F.col(label).alias("label"), F.to_json(F.struct(*[c for c in df.columns if c not in ("t", "k")])).alias("detail"),
        )

    union = part(1, "run", runs.withColumns({"t": F.lit(None).cast("timestamp_ntz"), "k": F.lit(0)}), "t", "k", "status")
    none = F.lit(None).cast("timestamp_ntz")
    for one in (
        part(2, "step", steps.withColumn("t", none), "t", "step_id", "node_name"),
        part(3, "tool_call", tool_calls, "started_at", "call_id", "tool_name"),
        part(4, "event", events.withColumn("t", none), "t", "sequence", "event_type"),
    ):
        union = union.unionByName(one)
    return union if run_id is None else union.orderBy(*TRACE_ORDER)


TRACE_ORDER = ("run_id", "section", "order_time", "order_id")


def session_messages(messages: DataFrame, session_id: object = None) -> DataFrame:
    """Messages of one session (or of all) in time order."""
    kept = messages if session_id is None else messages.filter(F.col("session_id") == F.lit(session_id))
    return kept.orderBy("session_id", "position")


def analytics_step_summary(calls: DataFrame) -> DataFrame:
    """Per request: its metric calls with their row counts, and how many. A plan has few calls."""
    ordered = F.sort_array(F.collect_list(F.struct("call_no", "metric_name", "row_count")))
    return calls.groupBy("request_id").agg(ordered.alias("metrics"), F.count(F.lit(1)).alias("tool_count"))


def retrieval_step_summary(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Per query, with or without a hit: chunk ids and scores in result order. A search returns at most 20 chunks."""
    ordered = F.sort_array(F.collect_list(F.struct(
        "result_rank", "chunk_id", "fts_rank", "vector_rank", "rrf_score"
    )))
    found = results.groupBy("query_id").agg(ordered.alias("scores"))
    return queries.select("query_id").join(found, "query_id", "left")


def terminal(column: str = "event_type") -> Column:
    return F.col(column).isin(*TERMINAL)
