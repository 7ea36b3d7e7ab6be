"""Running a function over whole texts in Arrow batches, and scratch tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmart.session import shared_folder

#: Most bytes of text that a step holds as Python objects at once.
SLICE_BYTES = 4_000_000
BATCH_BYTES = 16 << 20


def slices(values: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(start, texts) runs of a binary column; a null counts as empty. A run ends after ``limit`` bytes."""
    start, held, size = 0, [], 0
    for i, value in enumerate(values):
        text = value.as_py() or b""
        held.append(text)
        size += len(text)
        if size >= limit:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def limit_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lets Spark end an Arrow batch after so many bytes as well, so that long texts don't fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def per_text(
    docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list]], fields: str, keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """``keep`` columns of every row, then what the function made by ``make`` finds in the row's text.

    ``make`` is called once per task; its function gets a list of UTF-8 texts and returns, for each field
    of ``fields`` (a DDL string), a list of as many values. Other columns of ``docs`` are not read.
    """
    limit_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in keep]
    schema = T.StructType([docs.schema[c] for c in keep] + list(T.StructType.fromDDL(fields).fields))
    names = [f.name for f in schema.fields]
    types = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal types
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields[len(keep):]]
        function = make()
        for batch in batches:
            for start, texts in slices(batch.column(len(keep))):
                kept = [batch.column(i).slice(start, len(texts)) for i in range(len(keep))]
                made = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(function(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + made, names=names)

    return docs.select(*columns, F.col(f"`{text}`").cast("binary").alias("whole_text")).mapInArrow(run, schema)


def filter_rows(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list]], text: str = "text") -> DataFrame:
    """Rows of ``docs`` with all their columns whose text the function made by ``make`` answers with True."""
    limit_batches(docs.sparkSession)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start, texts in slices(batch.column(where).cast(pa.binary())):
                yield batch.slice(start, len(texts)).filter(pa.array(function(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def replace_texts(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list]], text: str = "text") -> DataFrame:
    """``docs`` with each text replaced by what the function returns; a null text stays null."""
    limit_batches(docs.sparkSession)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            column = batch.column(where).cast(pa.binary())
            for start, texts in slices(column):
                part = batch.slice(start, len(texts))
                nulls = column.slice(start, len(texts)).is_null().to_pylist()
                new = [None if gone else t.decode("utf-8", "replace") for gone, t in zip(nulls, function(texts), strict=True)]
                arrays = list(part.columns)
                arrays[where] = pa.array(new, batch.schema.field(where).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder for a written intermediate, shared by driver and executors."""
    return shared_folder(spark, f"{purpose}-{uuid.uuid4().hex}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps don't depend on executors that made it."""
    spark = df.sparkSession
    folder = scratch(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
