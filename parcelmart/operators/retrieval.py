"""Hybrid retrieval: a table of queries against an index of chunks.

Lexical candidates come from stored postings (``operators.postings``), vector candidates from packed cells (``operators.cells``); both
are fused by weighted reciprocal ranks and cut to the best few per query. Queries stay a table from start to end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmart.functions.text import excerpt, flag_injection, strip
from parcelmart.functions.tokens import tokenize
from parcelmart.functions.vectors import DIMENSIONS, hash_embedding
from parcelmart.operators import cells, postings

CHUNK_COLUMNS = postings.CHUNK_COLUMNS
MAX_TERMS = 18
CANDIDATES = 30
RRF_K = 60
FTS_WEIGHT, VECTOR_WEIGHT = 0.75, 0.25
BONUS_PER_TERM, BONUS_TERMS = 0.0001, 5
MODES = ("hybrid", "fts", "vector")
EXCERPT_CHARS = 800

# Fixed values: (trigger words, terms added to a query that contains one of them).
SYNONYMS: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (("延期", "延迟", "晚到", "late"), ("延期", "延迟", "配送", "送达", "delivery", "late")),
    (("包装", "破损", "包裹", "packaging"), ("包装", "发货", "破损", "检查", "packaging")),
    (("差评", "低分", "投诉", "review"), ("差评", "低分", "评论", "客户", "review")),
    (("卖家", "商家", "seller"), ("卖家", "绩效", "复盘", "seller")),
    (("运费", "物流成本", "freight"), ("运费", "成本", "物流", "freight")),
    (("支付", "信用卡", "分期", "payment"), ("支付", "付款", "信用卡", "分期", "payment")),
    (("证据", "引用", "报告", "evidence"), ("证据", "引用", "报告", "口径", "evidence")),
    (("安全", "审批", "越权", "security"), ("安全", "审批", "权限", "越权", "security")),
)


# --- queries -----------------------------------------------------------------------------------------


def _added_terms(lowered: Column) -> Column:
    none = F.array().cast("array<string>")
    groups = []
    for triggers, additions in SYNONYMS:
        met = F.lit(False)
        for trigger in triggers:
            met = met | F.contains(lowered, F.lit(trigger))
        groups.append(F.when(met, F.array(*[F.lit(a) for a in additions])).otherwise(none))
    return F.concat(*groups)


def expand_query(query: Column, max_terms: int = MAX_TERMS) -> Column:
    """Search terms: synonyms of the triggers met, then own tokens; no repeats, short ones or numbers."""
    lowered = F.lower(query)
    terms = F.concat(_added_terms(lowered), tokenize(lowered))
    useful = F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.rlike("^\\p{Nd}+$"))
    return F.slice(F.array_distinct(useful), 1, max_terms)


def prepare_queries(
    queries: DataFrame, dimensions: int = DIMENSIONS, kind: str = "blake2b", max_terms: int = MAX_TERMS
) -> DataFrame:
    """(query_id, query) -> stripped query with terms and embedding; blank queries are gone."""
    kept = queries.withColumn("query", strip("query")).filter("query <> ''")
    return kept.withColumn("terms", expand_query(F.col("query"), max_terms)).withColumn(
        "query_embedding", hash_embedding("query", dimensions, kind)
    )


# --- the index ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchIndex:
    """Chunks as they were when it was written, their postings, and their vectors packed in cells of a trained quantiser."""

    chunks: DataFrame
    postings: postings.Postings
    cells: DataFrame
    centroids: np.ndarray


def write_search_index(chunks: DataFrame, folder: str, n_cells: int | None = None, parts: bool = True) -> SearchIndex:
    """Builds the index of ``chunks`` below ``folder``. A search reads it as often as it likes; new chunks need a new one.

    Chunks are joined to their ready documents, so they are written first, numbered and with their vectors, and all passes over them read
    plain rows. Without ``parts`` the parts of the postings are left to the first search that follows words to their chunks: large batches and
    vectors don't need them. Such an index is of this application only; one to be read back has all parts.
    """
    below = f"{folder}/postings"
    numbered = postings.number_chunks(chunks.select(*[c for c in (*CHUNK_COLUMNS, "embedding") if c in chunks.columns]), below)
    known = postings.Postings(numbered.select("chunk_no", *[c for c in CHUNK_COLUMNS if c in chunks.columns]), below)
    centroids = cells.train_centroids(numbered, "chunk_id", "embedding", n_cells)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(centroids)]
    chunks.sparkSession.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    packed = cells.write_cells(cells.nearest_cells(numbered, "chunk_id", "embedding", centroids), f"{folder}/cells")
    return SearchIndex(known.chunks, postings.with_parts(known) if parts else known, packed, centroids)


def read_search_index(spark: SparkSession, folder: str) -> SearchIndex:
    """The index that was written to ``folder``."""
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").collect()
    known = postings.read_postings(spark, f"{folder}/postings")
    return SearchIndex(known.chunks, known, spark.read.parquet(f"{folder}/cells"),
                       np.array([r["centroid"] for r in rows]).reshape(len(rows), -1))


# --- candidates --------------------------------------------------------------------------------------

def lexical_candidates(index: SearchIndex, queries: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """Best n chunks per query by terms met in the title, terms met at all, matching word positions."""
    return postings.lexical_candidates(index.postings, queries, n)


def word_scores(index: SearchIndex, queries: DataFrame, n: int | None = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, fts_score): the n best chunks per query by matching word positions, ties to the smaller chunk_id; all that
    share a word where n is None."""
    return postings.word_scores(index.postings, queries, n)


def vector_candidates(
    index: SearchIndex, queries: DataFrame, n: int = CANDIDATES, probes: int | None = None
) -> DataFrame:
    """Nearest n chunks per query by cosine similarity: in the ``probes`` nearest cells, or in all (exact).

    A chunk without direction (all zero) ranks behind every other and has no score; one without a vector is no candidate; a
    query without direction finds nothing.
    """
    return nearest_vectors(index.cells, index.centroids, queries, n, key="chunk_id", probes=probes)


def nearest_vectors(packed: DataFrame, centroids: np.ndarray, queries: DataFrame, n: int = CANDIDATES, *, key: str, probes: int | None = None) -> DataFrame:
    """The same over any table of vectors written by ``cells.write_cells``."""
    if len(centroids) and (probes or len(centroids)) >= len(centroids):
        return cells.search_all(packed, queries, n, key, "query_embedding")
    asked = cells.nearest_cells(queries, "query_id", "query_embedding", centroids, probes or len(centroids))
    return cells.search_cells(packed, asked, n, key)


def write_vector_index(
    vectors: DataFrame, path: str, *, key: str, vector: str = "embedding", dimensions: int = DIMENSIONS, bits: int = 6, seed: int = 7,
) -> DataFrame:
    """Vectors in folders by sign code (2^bits at most): an index that needs no training."""
    return cells.write_cells(cells.code_cells(vectors, key, vector, dimensions, bits, seed), path)


def vector_candidates_lsh(
    index: DataFrame, queries: DataFrame, n: int = CANDIDATES, *, key: str, vector: str = "query_embedding",
    dimensions: int = DIMENSIONS, bits: int = 6, radius: int = 2, seed: int = 7,
) -> DataFrame:
    """Nearest n among rows whose sign code is within ``radius`` bits of the query's; exact at radius = bits."""
    return cells.search_cells(index, cells.code_cells(queries, "query_id", vector, dimensions, bits, seed, radius), n, key)


# --- fusion --------------------------------------------------------------------------------------------


SCORE_TYPES = {"title_hits": "int", "lexical_hits": "int", "fts_score": "double", "vector_score": "double"}


def rrf_fuse(
    lexical: DataFrame | None, vector: DataFrame | None, mode: str = "hybrid", k: int = RRF_K,
    fts_weight: float = FTS_WEIGHT, vector_weight: float = VECTOR_WEIGHT, candidates: int = CANDIDATES,
) -> DataFrame:
    """Union of both candidate lists with reciprocal-rank scores (rounded to 8 places)."""
    parts = []
    for name, rank, frame in (("lexical", "fts_rank", lexical), ("vector", "vector_rank", vector)):
        if frame is not None:
            kept = [c for c in ("query_id", "chunk_id", rank, *SCORE_TYPES) if c in frame.columns]
            parts.append(frame.select(*kept).withColumnRenamed(rank, "list_rank").withColumn("listing", F.lit(name)))
    entries = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return fuse_entries(entries, mode, k, fts_weight, vector_weight, candidates)


def fuse_entries(
    entries: DataFrame, mode: str = "hybrid", k: int = RRF_K, fts_weight: float = FTS_WEIGHT,
    vector_weight: float = VECTOR_WEIGHT, candidates: int = CANDIDATES,
) -> DataFrame:
    """List entries -> one row per (query, chunk). The lists are short; grouping them takes no join."""
    if mode not in MODES:
        raise ValueError(f"Unsupported retrieval mode: {mode}")
    gaps = {c: F.lit(None).cast(t) for c, t in SCORE_TYPES.items() if c not in entries.columns}
    rank_in = lambda name: F.max(F.when(F.col("listing") == name, F.col("list_rank")))
    merged = entries.withColumns(gaps).groupBy("query_id", "chunk_id").agg(
        *[F.max(c).alias(c) for c in SCORE_TYPES],
        rank_in("lexical").alias("fts_rank"), rank_in("vector").alias("vector_rank"),
    ).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fts_score", "lexical_hits", "title_hits")})

    def part(rank: str, weight: float) -> Column:
        return F.coalesce(F.lit(weight) / (F.col(rank) + k), F.lit(0.0))

    if mode == "hybrid":
        fused = part("fts_rank", fts_weight) + part("vector_rank", vector_weight)
    else:
        rank = "fts_rank" if mode == "fts" else "vector_rank"
        fused = F.lit(1.0) / (F.coalesce(rank, F.lit(candidates + 1)) + k)
    return merged.withColumn("fused_score", fused).withColumn("rrf_score", F.round("fused_score", 8))


def rerank_bonus(terms: Column, title: Column, heading_path: Column) -> Column:
    """Small plus for terms found in the title or the headings."""
    heading = F.lower(F.array_join(heading_path, " "))
    met = F.size(F.filter(terms, lambda t: F.contains(F.lower(title), F.lower(t)) | F.contains(heading, F.lower(t))))
    return F.least(met, F.lit(BONUS_TERMS)) * F.lit(BONUS_PER_TERM)


def hybrid_search(
    index: SearchIndex, queries: DataFrame, limit: int = 5, mode: str = "hybrid", *, candidate_k: int = CANDIDATES,
    k: int = RRF_K, fts_weight: float = FTS_WEIGHT, vector_weight: float = VECTOR_WEIGHT, rerank: bool = False,
    probes: int | None = None,
) -> DataFrame:
    """Best chunks per prepared query, ``result_rank`` 1 first."""
    if mode not in MODES:
        raise ValueError(f"Unsupported retrieval mode: {mode}")
    wanted = max(1, min(limit, 20))
    n = max(wanted, min(candidate_k, 200))
    lexical = lexical_candidates(index, queries, n) if mode != "vector" else None
    vector = vector_candidates(index, queries, n, probes) if mode != "fts" else None
    fused = rrf_fuse(lexical, vector, mode, k, fts_weight, vector_weight, n)
    return best_results(fused, queries, index.chunks, wanted, mode, rerank)


def best_results(
    fused: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int, mode: str, rerank: bool = False
) -> DataFrame:
    """The first ``limit`` per query, with the columns of their chunks, which are joined to these only."""
    bonus = F.lit(0.0)
    if rerank:
        fused = fused.join(queries.select("query_id", "terms"), "query_id").join(
            chunks.select("chunk_id", "title", "heading_path"), "chunk_id")
        bonus = rerank_bonus(F.col("terms"), F.col("title"), F.col("heading_path"))
    scored = fused.withColumn("rerank_score", F.round(F.col("fused_score") + bonus, 8))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rerank_score"), F.desc("title_hits"), F.desc("lexical_hits"),
        F.desc(F.coalesce("vector_score", F.lit(-1.0))), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vector_rank"),
    )
    best = scored.withColumn("result_rank", F.row_number().over(order)).filter(F.col("result_rank") <= limit)
    best = best.drop(*[c for c in CHUNK_COLUMNS if c != "chunk_id"]).join(chunks.select(*CHUNK_COLUMNS), "chunk_id")
    return best.select(
        "query_id", "result_rank", *CHUNK_COLUMNS, "fts_score", "lexical_hits", "title_hits", "fts_rank",
        "vector_score", "vector_rank", "rrf_score", "rerank_score",
        F.lit(mode).alias("retrieval_mode"), F.lit("local_hash").alias("embedding_provider"),
        flag_injection("content").alias("potential_injection"),
    )


def search_excerpt(results: DataFrame) -> DataFrame:
    """Results with a short excerpt in place of the content."""
    return results.withColumn("excerpt", excerpt("content", EXCERPT_CHARS)).drop("content")


def search_log(
    queries: DataFrame, results: DataFrame, lexical: DataFrame | None, vector: DataFrame | None, mode: str,
    duration_ms: float,
) -> DataFrame:
    """One log row per query: terms, candidate counts, result ids (few per query) and the time taken."""
    def counted(frame: DataFrame | None, name: str) -> DataFrame:
        if frame is None:
            return queries.select("query_id", F.lit(0).cast("bigint").alias(name))
        return frame.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))

    ids = results.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("result_rank", "chunk_id"))), lambda r: r["chunk_id"])
        .alias("result_chunk_ids")
    )
    joined = queries.join(ids, "query_id", "left")
    for frame, name in ((lexical, "lexical_candidate_count"), (vector, "vector_candidate_count")):
        joined = joined.join(counted(frame, name), "query_id", "left")
    return joined.select(
        "query_id", "query", F.lit(mode).alias("retrieval_mode"), F.col("terms").alias("expanded_terms"),
        F.coalesce("lexical_candidate_count", F.lit(0)).alias("lexical_candidate_count"),
        F.coalesce("vector_candidate_count", F.lit(0)).alias("vector_candidate_count"),
        F.coalesce("result_chunk_ids", F.array().cast("array<string>")).alias("result_chunk_ids"),
        F.lit(float(duration_ms)).alias("duration_ms"), F.current_timestamp().alias("created_at"),
    )


# --- evaluation ------------------------------------------------------------------------------------------


def first_hits(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Per gold case the rank of the first result whose title is a gold title (NULL: none)."""
    wanted = gold.select("query_id", F.explode("gold_titles").alias("title")).distinct()
    hits = results.select("query_id", "title", "result_rank").join(wanted, ["query_id", "title"])
    first = hits.groupBy("query_id").agg(F.min("result_rank").alias("first_hit_rank"))
    return gold.select("query_id").join(first, "query_id", "left").withColumn(
        "passed", F.col("first_hit_rank").isNotNull()
    )


def retrieval_eval(results: DataFrame, gold: DataFrame, top_k: int = 5) -> DataFrame:
    """One row: cases, recall, mean reciprocal rank and top-1 share, each to 4 places (0 without cases)."""
    totals = first_hits(results.filter(F.col("result_rank") <= top_k), gold).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("hits"),
        F.coalesce(F.sum(F.lit(1.0) / F.col("first_hit_rank")), F.lit(0.0)).alias("reciprocal"),
        F.count_if(F.col("first_hit_rank") == 1).alias("top1"),
    )

    def share(name: str) -> Column:
        return F.when(F.col("total") > 0, F.round(F.col(name) / F.col("total"), 4)).otherwise(0.0)

    return totals.select(
        "total", share("hits").alias(f"recall_at_{top_k}"), share("reciprocal").alias("mrr"),
        share("top1").alias("top1_accuracy"),
    )
