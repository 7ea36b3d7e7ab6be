"""The subpackage's queries over a folder of tables, with production parameters, and oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmart.llm.bilinear import score_texts
from parcelmart.llm.block_search import ranked_search
from parcelmart.llm.conversations import damage, repair_report
from parcelmart.llm.decontaminate import benchmark_hits
from parcelmart.llm.licenses import license_scan
from parcelmart.llm.passages import repeated_passages
from parcelmart.llm.pieces import round_trip_digests
from parcelmart.llm.quality import quality_rules
from parcelmart.llm.simhash import near_duplicates
from parcelmart.llm.small_world import nearest_neighbours
from parcelmart.llm.token_counts import token_counts
from parcelmart.llm.token_files import token_file_report
from parcelmart.llm.urls import judge_urls

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
#: The URL query's list: pages of hosts of these names, and pages with such a title.
REPORTED = r"(^|\.)(spam-farm|cheap-pills)\."
JUNK_TITLE = r"<title>[^<]*([#*$%]{3}|[A-Z]{3}[^<a-z]*!)"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"), tokenizer_path(PIECES))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan(read(spark, folder, "documents"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_file_report(read(spark, folder, "documents"), tokenizer_path(BYTES))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(read(spark, folder, "documents")).drop("version")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_hits(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("spans")


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_digests(read(spark, folder, "documents"), tokenizer_path(PIECES))


def op9_log_bilinear_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(read(spark, folder, "documents"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Judges every page; the list is the canonical URLs of pages of reported hosts and of pages with a junk title."""
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    host = F.regexp_extract(F.lower("url"), r"://([^/?#]*)", 1)
    return judge_urls(pages, pages.where(host.rlike(REPORTED) | F.col("html").rlike(JUNK_TITLE)))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = read(spark, folder, "conversations")
    return repair_report(conversations, damage(conversations))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(read(spark, folder, "documents"), read(spark, folder, "benchmark"), 20)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def jobs():
    return {f.__name__: f for f in (
        op1_token_counts, op2_quality_rules, op3_license_scan, op4_token_files, op5_simhash_near_dedup,
        op6_repeated_passages, op7_decontamination, op8_sentencepiece, op9_log_bilinear_scores, op10_url_filter, op11_conversation_repair,
        op12_nearest_neighbours, op13_ranked_search, pipeline)}


_RULES = """
    SELECT page_id, host, path, CASE
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule,
        regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html?|/+)$', '') AS canonical, html
    FROM (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
          FROM (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest
                FROM pages))
"""
_TERMS = """
    SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}
"""
ORACLE = {
    "op10_url_filter": f"""
        WITH judged AS ({_RULES}),
        listed AS (SELECT DISTINCT canonical FROM judged
                   WHERE (regexp_matches(host, '(^|\\.)(spam-farm|cheap-pills)\\.')
                          OR regexp_matches(html, '<title>[^<]*([#*$%]{{3}}|[A-Z]{{3}}[^<a-z]*!)')) AND canonical <> '')
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               l.canonical IS NOT NULL AS listed
        FROM judged LEFT JOIN listed l USING (canonical)
    """,
    "op13_ranked_search": f"""
        WITH words AS ({_TERMS.format(key="doc_id", table="documents")}),
        postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
        corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
        lengths AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM sizes, corpus),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
                    FROM postings, corpus GROUP BY term),
        asked AS (SELECT item_id, term, count(*) AS times FROM ({_TERMS.format(key="item_id", table="benchmark")}) GROUP BY ALL),
        scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                   FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL)
        SELECT item_id, rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
        WHERE rank <= 20
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
