"""From raw documents to encoded ones: STAGES in order, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it to the shared folder and reads it for
the next. All but the last return the columns of the documents table, whatever they are; the last returns the digests
of the encoded texts. Rows without doc_id pass the stages that compare documents unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmart.llm.decontaminate import without_benchmark
from parcelmart.llm.passages import without_repeats
from parcelmart.llm.pieces import round_trip_digests
from parcelmart.llm.quality import keep_good
from parcelmart.llm.queries import PIECES, read, tokenizer_path
from parcelmart.llm.simhash import keep_one_of_each
from parcelmart.llm.texts import written


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that has been cut."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*[f"`{c}`" for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return keep_one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay only where they stand first."""
    return _with_length(without_repeats(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark phrases are cut out."""
    return _with_length(without_benchmark(docs, read(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document, as digests."""
    return round_trip_digests(docs, tokenizer_path(PIECES))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("benchmark", benchmark),
    ("encoding", encoding),
]
#: Trees, fingerprint components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
