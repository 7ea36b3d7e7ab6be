"""Knowledge base: documents -> chunks -> embeddings.

Every document is split inside its own row with native expressions, so chunking needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmart.functions.text import strip
from parcelmart.functions.vectors import DIMENSIONS, hash_embedding

TARGET_CHARS = 600
PARAGRAPH_BREAK = "\n\n"

# All line ends Python's str.splitlines knows, besides the plain newline.
_OTHER_LINE_ENDS = "\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
_BLANK = "[^\\S\\n]"
_HEADING_LINE = f"(?U)^(#{{1,6}}){_BLANK}+([^\\n]+)"
_BEFORE_HEADING = f"(?Udm)^(?=#{{1,6}}{_BLANK}[^\\n])"
_TITLE = "(?Udm)^(#{1,6})\\s+(.+)$"


def content_hash(text: Column | str) -> Column:
    return F.sha2(text, 256)


def doc_title(text: Column | str, stem: Column | str) -> Column:
    """Text of the first Markdown heading, else the file stem."""
    found = strip(F.regexp_extract(text, _TITLE, 2))
    has_heading = F.regexp_extract(text, _TITLE, 1) != ""
    return F.when(has_heading, found).otherwise(F.col(stem) if isinstance(stem, str) else stem)


def dedup_documents(documents: DataFrame, order: str) -> DataFrame:
    """One row per distinct text; the row with the largest ``order`` gives the metadata.

    A NULL order counts as lowest; rows with the same text and order differ by a hash of their other columns, and of
    rows that are equal in all columns one stays. Hash, order and row hash are aggregated, with a map-side maximum, so a
    text with millions of copies is no hot group, and the texts themselves move at most once.
    """
    others = [c for c in documents.columns if c != "text"]
    hashed = documents.withColumn("content_hash", content_hash("text")).withColumn("row_hash", F.xxhash64(*others))
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("order"), F.col("row_hash").alias("row_hash"))
    last = hashed.groupBy("content_hash").agg(F.max(place).alias("last")).select("content_hash", "last.row_hash")
    kept = hashed.join(last, ["content_hash", "row_hash"], "left_semi")
    # One row_hash is left per text, so both keys say the same as the text's hash alone, and rows lie by both from the join.
    return kept.dropDuplicates(["content_hash", "row_hash"]).drop("row_hash").select(*documents.columns, "content_hash")


def knowledge_documents(files: DataFrame, order: str, stem: str = "stem") -> DataFrame:
    """Distinct documents with title; ``document_id`` is the content hash, so an edit is a new document."""
    return dedup_documents(files, order).withColumn("title", doc_title("text", stem)).withColumn(
        "document_id", F.col("content_hash")
    )


def _sections(text: Column) -> Column:
    lines = F.regexp_replace(text, _OTHER_LINE_ENDS, "\n")
    return F.split(lines, _BEFORE_HEADING, -1)


def _headings(sections: Column) -> Column:
    return F.transform(sections, lambda s: F.struct(
        F.length(F.regexp_extract(s, _HEADING_LINE, 1)).alias("level"),
        strip(F.regexp_extract(s, _HEADING_LINE, 2)).alias("title"),
    ))


def _paths(headings: Column) -> Column:
    """Heading path of each section: level n keeps the first n - 1 entries and appends itself."""
    start = F.struct(
        F.array().cast("array<string>").alias("path"), F.array().cast("array<array<string>>").alias("all")
    )

    def step(acc: Column, heading: Column) -> Column:
        level = heading["level"]
        path = F.when(level == 0, acc["path"]).otherwise(
            F.concat(F.slice(acc["path"], F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(heading["title"]))
        )
        return F.struct(path.alias("path"), F.array_append(acc["all"], path).alias("all"))

    return F.aggregate(headings, start, step, lambda acc: acc["all"])


def _pack(body: Column, target_chars: int, sep: str) -> Column:
    """Greedy packing of paragraphs. A paragraph is never split; a full buffer starts a new chunk."""
    literal = "\\Q" + sep + "\\E"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"))

    def step(acc: Column, paragraph: Column) -> Column:
        longer = strip(F.concat(acc["buffer"], F.lit(sep), paragraph))
        full = (acc["buffer"] != "") & (F.length(longer) > target_chars)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["buffer"])).otherwise(acc["done"]).alias("done"),
            F.when(full, paragraph).otherwise(longer).alias("buffer"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["buffer"] != "", F.array_append(acc["done"], acc["buffer"])).otherwise(acc["done"])

    return F.aggregate(F.split(body, literal, -1), start, step, finish)


def chunk_documents(
    documents: DataFrame, target_chars: int = TARGET_CHARS, sep: str = PARAGRAPH_BREAK
) -> DataFrame:
    """Chunks of each document: (document_id, title, ordinal, heading_path, content, hash, token count).

    ``documents`` has document_id, title, text and content_hash.
    """
    split = documents.withColumn("section_list", _sections(F.col("text"))).withColumn(
        "path_list", _paths(_headings(F.col("section_list")))
    )
    pieces = F.flatten(F.transform(
        F.arrays_zip("section_list", "path_list"),
        lambda s: F.transform(
            _pack(strip(F.regexp_replace(s["section_list"], _HEADING_LINE, "")), target_chars, sep),
            lambda piece: F.struct(s["path_list"].alias("heading_path"), piece.alias("content")),
        ),
    ))
    rows = split.select(
        "document_id", "title", F.col("content_hash").alias("document_hash"),
        F.posexplode(pieces).alias("ordinal", "piece"),
    )
    return rows.select(
        F.sha2(F.concat_ws(":", "document_hash", F.col("ordinal").cast("string"), "piece.content"), 256)
        .alias("chunk_id"),
        "document_id", "title", "ordinal", "piece.heading_path", "piece.content",
        F.greatest(F.lit(1), F.floor(F.length("piece.content") / 3)).cast("int").alias("token_count"),
    )


def embedding_text(title: str = "title", path: str = "heading_path", content: str = "content") -> Column:
    return F.array_join(F.concat(F.array(F.col(title)), F.col(path), F.array(F.col(content))), "\n")


def embed_chunks(chunks: DataFrame, dimensions: int = DIMENSIONS, kind: str = "blake2b") -> DataFrame:
    return chunks.withColumn("embedding", hash_embedding(embedding_text(), dimensions, kind))


def knowledge_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunk, embedding and document counts and the embedded share."""
    counts = chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count("embedding").alias("embedded_chunk_count"),
        F.count_distinct("document_id").alias("document_count"),
    )
    coverage = F.when(
        F.col("chunk_count") > 0, F.round(F.col("embedded_chunk_count") / F.col("chunk_count"), 4)
    ).otherwise(0.0)
    return counts.withColumn("embedding_coverage", coverage)


def document_status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count(F.lit(1)).alias("document_count"))


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunk counts, by title. Chunks are counted before the join."""
    counts = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count("embedding").alias("embedded_chunk_count")
    )
    zero = F.lit(0)
    return documents.join(counts, "document_id", "left").select(
        "document_id", "title", "source_type", "source_url", "status", "metadata", "updated_at", F.coalesce("chunk_count", zero).alias("chunk_count"),
        F.coalesce("embedded_chunk_count", zero).alias("embedded_chunk_count"),
    ).orderBy("title", "document_id")
