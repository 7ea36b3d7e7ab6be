"""Checks between data and report: evidence gate, citations, critic, redaction of flagged chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelmart.functions.text import REDACTED_CHUNK, excerpt, flag_injection, strip

CITATION_CHARS = 240
MAX_RESULT_ROWS = 10
# The warnings a reader of results matches on.
NOT_USABLE = "The date range or the minimum of orders cannot be used."
NO_ROWS = "No structured rows matched the requested filters."
NO_KNOWLEDGE = "No matching policy chunk was found; recommendations are limited to data-supported observations."

# Traces of a prompt that must not appear in a report.
LEAK_MARKERS = ("<think>", "<evidence>", "system prompt", "忽略以上指令", "json对象")
CITATION = r"(?U)\bK-[0-9]{3}\b"
CHECKS = (
    "non_empty", "markdown_heading", "section_structure", "citation_coverage", "citation_validity",
    "no_prompt_leakage",
)


def redact_injected_chunks(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Flagged chunks lose their text."""
    return chunks.withColumn("potential_injection", flag_injection(content)).withColumn(
        content, F.when(F.col("potential_injection"), F.lit(REDACTED_CHUNK)).otherwise(F.col(content))
    )


def injection_warnings(redacted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One warning per flagged chunk."""
    return redacted.filter("potential_injection").select(key, F.format_string(
        "Knowledge chunk %s contains a possible prompt injection.", F.col(key).cast("string")
    ).alias("warning"))


def evidence_gate(requests: DataFrame, calls: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per request: pass, insufficient or (parameters that can't be used) failed, with its warning.

    ``requests`` has request_id, intent and usable, ``calls`` one row per metric call with row_count,
    ``retrieved`` one row per chunk found for a request.
    """
    analytics = calls.groupBy("request_id").agg(F.max(F.col("row_count") > 0).alias("has_rows"))
    knowledge = retrieved.groupBy("request_id").agg(F.count(F.lit(1)).alias("chunks"))
    joined = requests.select("request_id", "intent", "usable").join(analytics, "request_id", "left").join(
        knowledge, "request_id", "left"
    )
    empty = ~F.coalesce("has_rows", F.lit(False))
    unsupported = (F.col("intent") != "sales_summary") & (F.coalesce("chunks", F.lit(0)) == 0)
    return joined.select(
        "request_id",
        F.when(~F.col("usable"), F.lit("failed")).when(empty, F.lit("insufficient")).otherwise(F.lit("pass"))
        .alias("evidence_status"),
        F.when(~F.col("usable"), F.lit(NOT_USABLE)).when(empty, F.lit(NO_ROWS)).when(unsupported, F.lit(NO_KNOWLEDGE)).alias("warning"),
    )


def citation_id(number: Column) -> Column:
    return F.format_string("K-%03d", number)


def number_citations(results: DataFrame, request: str, order: str, content: str = "content") -> DataFrame:
    """Chunks of a request become K-001, K-002, ... with a short excerpt."""
    position = F.row_number().over(Window.partitionBy(request).orderBy(order))
    return results.withColumn("citation", citation_id(position)).withColumn(
        "citation_excerpt", excerpt(content, CITATION_CHARS)
    )


def critic_checks(reports: DataFrame, report: str = "report", chunk_count: str = "chunk_count") -> DataFrame:
    """Six yes/no checks of a report against its ``chunk_count`` numbered chunks, their mean and verdict."""
    answer = strip(report)
    no_strings = F.array().cast("array<string>")
    wanted = F.when(
        F.col(chunk_count) > 0, F.transform(F.sequence(F.lit(1), F.col(chunk_count).cast("int")), citation_id)
    ).otherwise(no_strings)
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(0)))
    lowered = F.lower("answer")
    leaked = F.lit(False)
    for marker in LEAK_MARKERS:
        leaked = leaked | F.contains(lowered, F.lit(marker))
    rows = reports.withColumn("answer", answer).withColumns({"wanted": wanted, "cited": cited})
    rows = rows.withColumns({
        "non_empty": F.col("answer") != "",
        "markdown_heading": F.startswith(F.col("answer"), F.lit("#")),
        "section_structure": F.regexp_count("answer", F.lit("## ")) >= 2,
        "citation_coverage": F.size(F.array_except("wanted", "cited")) == 0,
        "citation_validity": F.size(F.array_except("cited", "wanted")) == 0,
        "no_prompt_leakage": ~leaked,
    })
    met = sum((F.col(c).cast("int") for c in CHECKS[1:]), F.col(CHECKS[0]).cast("int"))
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in CHECKS]))
    return rows.withColumns({
        "score": F.round(met / F.lit(len(CHECKS)), 4), "passed": met == len(CHECKS),
        "failed_checks": F.array_join(failed, ", "),
        "expected_citations": F.array_join("wanted", " "),
        "observed_citations": F.array_join(F.array_sort("cited"), " "),
    }).drop("answer", "wanted", "cited")


def compact_result(rows: DataFrame, result: list[str], order: list[Column], max_rows: int = MAX_RESULT_ROWS) -> DataFrame:
    """First ``max_rows`` rows of each result, in its own order."""
    position = F.row_number().over(Window.partitionBy(*result).orderBy(*order))
    return rows.withColumn("row_no", position).filter(F.col("row_no") <= max_rows)
