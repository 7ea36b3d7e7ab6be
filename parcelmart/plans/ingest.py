"""Knowledge ingestion as one job: files -> documents -> chunks with embeddings, written as Parquet."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmart.functions.vectors import DIMENSIONS
from parcelmart.operators import knowledge as k


def ingest_knowledge(
    spark: SparkSession, files: DataFrame, folder: str, *, order: str = "filename", stem: str = "stem",
    target_chars: int = k.TARGET_CHARS, sep: str = k.PARAGRAPH_BREAK, dimensions: int = DIMENSIONS,
    kind: str = "blake2b", provider: str = "local_hash",
) -> tuple[DataFrame, DataFrame]:
    """Adds ``files`` (text, stem, an ordering column) to the knowledge in ``folder``; returns (documents, chunks).

    A document is its text: one that is there already is replaced with its chunks, an edited file is a new document,
    and all others stay. Each load appends a batch: the distinct texts to a work table, from which chunks are cut,
    then the chunks, and last the documents as 'ready'. Readers take a document's latest ready batch and
    that batch's chunks, so they never see a document without its chunks, nor chunks of a load that failed.
    """
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    pending = k.knowledge_documents(files, order, stem)
    pending.write.option("compression", "zstd").parquet(f"{folder}/documents_pending/batch={batch}")
    stored = spark.read.schema(pending.schema).parquet(f"{folder}/documents_pending/batch={batch}")
    chunks = k.embed_chunks(k.chunk_documents(stored, target_chars, sep), dimensions, kind)
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks/batch={batch}")
    stored.select(
        "document_id", "title", F.col(stem).alias("stem"), F.concat(F.lit("seed://"), F.col(stem)).alias("source_url"),
        F.lit("seed").alias("source_type"), "content_hash", F.lit("ready").alias("status"),
        F.to_json(F.struct(F.lit(dimensions).alias("embedding_dimensions"), F.lit(provider).alias("embedding_provider")))
        .alias("metadata"), F.current_timestamp().alias("updated_at"),
    ).write.parquet(f"{folder}/documents/batch={batch}")
    return read_knowledge(spark, folder)


def pending_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The work table of all ingestions, the latest text of each document: document_id, title and the text."""
    return _latest(spark.read.parquet(f"{folder}/documents_pending"))


def _only_batch(rows: DataFrame) -> str | None:
    """The batch of all rows, if there is just one: then it is every document's latest, and nothing needs to be joined."""
    first, last = rows.select(F.col("batch").cast("string").alias("batch")).agg(F.min("batch"), F.max("batch")).first()
    return first if first == last else None


def _latest(rows: DataFrame) -> DataFrame:
    """The rows of each document's latest batch. Batches per document are summed map-side, then joined."""
    if _only_batch(rows):
        return rows.where("document_id IS NOT NULL").drop("batch")
    last = rows.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["document_id", "batch"], "left_semi").drop("batch")


def read_knowledge(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks): the latest ready batch of each document, and that batch's chunks."""
    documents = spark.read.parquet(f"{folder}/documents")
    chunks = spark.read.parquet(f"{folder}/chunks")
    only = _only_batch(documents)
    if only and documents.where("NOT status <=> 'ready'").isEmpty():  # a batch's documents are written last, so all its chunks have theirs
        return _latest(documents), chunks.where((F.col("batch").cast("string") == only) & F.col("document_id").isNotNull()).drop("batch")
    last = documents.filter("status = 'ready'").groupBy("document_id").agg(F.max("batch").alias("last"))
    # Met by the document alone, so that a later join by document finds the chunks dealt already; an equation would become a second key.
    held = chunks.join(last, "document_id").where("batch >= last AND batch <= last").drop("batch", "last")
    return _latest(documents), held


def ready_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of documents that are there and ready; those of a half-loaded or absent document are not."""
    return chunks.join(documents.filter("status = 'ready'").select("document_id"), "document_id", "left_semi")
