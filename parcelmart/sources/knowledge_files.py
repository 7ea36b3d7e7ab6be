"""Knowledge inputs: Markdown files and gold cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD_SCHEMA = "id string, query string, gold_titles array<string>"


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Each ``*.md`` file as one row (filename, stem, text)."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(
        F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text")
    )
    if not files.take(1):
        raise FileNotFoundError(f"No Markdown files in {folder}")
    return files.withColumn("stem", F.regexp_replace("filename", "\\.md$", ""))


def read_gold_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases, one JSON object per line: query_id, query, gold_titles."""
    cases = spark.read.schema(GOLD_SCHEMA).json(path, mode="FAILFAST")
    return cases.withColumnRenamed("id", "query_id")
