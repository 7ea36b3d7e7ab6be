from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmart.operators import cells
from parcelmart.operators import knowledge as k
from parcelmart.operators import postings
from parcelmart.operators import retrieval as r
from parcelmart.plans.ingest import ingest_knowledge, ready_chunks
from parcelmart.sources.knowledge_files import read_gold_jsonl, read_markdown

WORDS = ["late", "parcel", "freight", "seller", "a_b", "delivery", "score", "policy", "12", "运费", "延期"]


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    docs = [
        (f"{i:03}.md", f"doc {WORDS[i % 5]} {i % 7}", " ".join(rng.choice(WORDS, 12)) + f" axb {i}") for i in range(150)
    ]
    files = spark.createDataFrame(docs, "filename string, stem string, text string")
    return ready_chunks(*ingest_knowledge(spark, files, str(tmp_path_factory.mktemp("kb")), dimensions=64))


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return r.write_search_index(chunks, str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def queries(spark):
    texts = ["late parcel policy", "freight  a_b ", "   ", "运费 seller", "?!", "12 34", "delivery score late"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    return r.prepare_queries(df, dimensions=64).cache()


def test_expansion(queries):
    terms = {q.query_id: list(q.terms) for q in queries.collect()}
    assert terms[0] == ["延期", "延迟", "配送", "送达", "delivery", "late", "parcel", "policy"]
    assert terms[3] == ["卖家", "绩效", "复盘", "seller", "运费", "成本", "物流", "freight"]
    assert terms[1] == ["运费", "成本", "物流", "freight", "a_b"]
    assert 2 not in terms and terms[4] == [] and terms[5] == []


def test_at_most_18_terms(spark):
    df = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40)))], "query_id int, query string")
    assert len(r.prepare_queries(df).first().terms) == 18


def slow_lexical(rows, terms, n):
    import re

    def like(term, text):
        return re.search(".".join(map(re.escape, term.split("_"))), text.lower(), re.DOTALL) is not None

    scored = []
    for c in rows:
        title = sum(like(t, c.title) for t in terms)
        hits = sum(like(t, c.title) or like(t, c.content) for t in terms)
        words = sum(w in terms for w in re.findall(r"[^\W_]+", c.content.lower()))
        if hits:
            scored.append(((-title, -hits, -words, c.title, c.ordinal, c.chunk_id), c.chunk_id))
    return [i for _, i in sorted(scored)[:n]]


def check_lexical(index, queries, n):
    rows = index.chunks.collect()
    found = r.lexical_candidates(index, queries, n).orderBy("fts_rank").collect()
    for q in queries.collect():
        assert [f.chunk_id for f in found if f.query_id == q.query_id] == slow_lexical(rows, list(q.terms), n)


@pytest.mark.parametrize("n", [3, 500])
def test_lexical_against_a_full_comparison(index, queries, n):
    check_lexical(index, queries, n)


def test_lexical_with_titles_parts_of_words_and_wildcards(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["parcel", "parcels", "late", "plate", "lat_e", "late-fee", "ab", "a", "b", "运费成本", "ÉTÉ", "x1", "latte", "a-b", "Late"]
    rows = [(f"c{i:03}", f"d{i // 3}", " ".join(rng.choice(words, 2)) if i % 4 else "the late title", i % 3, ["h"],
             " ".join(rng.choice(words, rng.integers(0, 9))) + "." * (i % 3), [float(i % 5), 1.0]) for i in range(400)]
    chunks = spark.createDataFrame(
        rows, "chunk_id string, document_id string, title string, ordinal int, heading_path array<string>, content string, embedding array<float>")
    texts = ["late", "parcel late a_b", "la_e plate", "运费 ab x1", "late-fee été", "nowhere", "a_ b1 lat", "title the", "ab _ __ a__"]
    asked = r.prepare_queries(spark.createDataFrame(list(enumerate(texts)), "query_id int, query string"), dimensions=64)
    built = r.SearchIndex(chunks, postings.write_postings(chunks, str(tmp_path / "p")), None, None)
    for n in (2,):
        check_lexical(built, asked, n)


def test_common_words_are_not_followed_to_their_chunks(spark, tmp_path):
    """Every chunk has the common words, twenty have a rare one as well: only those are looked at."""
    rows = [(f"c{i:05}", "d", f"t{i}", 0, ["h"], "the common words of all" + (" zebra" if i % 100 == 0 else "")) for i in range(2000)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, title string, ordinal int, heading_path array<string>, content string")
    index = postings.write_postings(chunks, str(tmp_path / "p"))
    asked = r.prepare_queries(spark.createDataFrame([(1, "the common words zebra")], "query_id int, query string"), dimensions=64)
    known = postings.asked_terms(index, asked)
    terms = known.terms.orderBy("place").collect()
    assert terms[0]["term"] == "zebra" and [t["met"] for t in terms] == [4] * 4
    assert postings.chunks_of_terms(known.terms.where("place <= met - 4 + 1"), known, index).count() == 20
    best = postings.lexical_candidates(index, asked, 10).orderBy("fts_rank").collect()
    assert [b["title"] for b in best] == sorted(f"t{i}" for i in range(0, 2000, 100))[:10]


def test_places_stay_where_few_words_are_followed(index, queries, monkeypatch):
    """All places used to be shuffled by word, twice in a search."""
    known = postings.asked_terms(index.postings, queries)
    rows = {}
    for limit, shuffled in ((200_000, False), (0, True)):
        monkeypatch.setattr(postings, "BROADCAST_ROWS", limit)
        found = postings.chunks_of_terms(known.terms, known, index.postings)
        assert ("hashpartitioning(word" in found._jdf.queryExecution().executedPlan().toString()) == shuffled
        rows[limit] = sorted(map(tuple, found.collect()))
    assert rows[0] == rows[200_000] and rows[0]


def test_queries_stay_a_table(index, queries, monkeypatch):
    from pyspark.sql import DataFrame

    def refuse(self, *a, **k):
        raise AssertionError("collected")

    monkeypatch.setattr(DataFrame, "toPandas", refuse, raising=False)
    assert r.hybrid_search(index, queries, 5).count() > 0
    assert r.word_scores(index, queries, 5).count() > 0


def check_vectors(index, chunks, queries, n):
    rows = chunks.collect()
    found = r.vector_candidates(index, queries, n).orderBy("vector_rank").collect()
    for q in queries.collect():
        v = np.array(q.query_embedding, dtype=float)
        mine = [(f.chunk_id, f.vector_score) for f in found if f.query_id == q.query_id]
        if not v.any():
            assert mine == []
            continue
        scored = sorted(
            (-round(float(v @ np.array(c.embedding) / np.linalg.norm(v) / np.linalg.norm(c.embedding)), 8), c.chunk_id)
            for c in rows
        )[:n]
        assert [m[0] for m in mine] == [c for _, c in scored]
        assert [m[1] for m in mine] == pytest.approx([-s for s, _ in scored], abs=1e-7)


@pytest.mark.parametrize("pack, block", [(1 << 20, 1 << 17), (64 * 3, 64)])
def test_vector_against_a_full_comparison(index, chunks, queries, tmp_path, monkeypatch, pack, block):
    """The second case packs three vectors to a row and one query to a block."""
    monkeypatch.setattr(cells, "PACK_NUMBERS", pack)
    monkeypatch.setattr(cells, "QUERY_NUMBERS", block)
    coded = cells.nearest_cells(chunks, "chunk_id", "embedding", index.centroids)
    check_vectors(r.SearchIndex(chunks, None, cells.write_cells(coded, str(tmp_path / "c")), index.centroids), chunks, queries, 20)


@pytest.mark.parametrize("share, block, scores", [(64 * 40, 64 * 2, 30), (64 * 3, 1 << 20, 1 << 20)])
def test_exact_search_in_shares_and_blocks(index, chunks, queries, monkeypatch, share, block, scores):
    """No query is repeated for every cell, and nothing is broadcast: that broadcast failed over a thousand cells."""
    monkeypatch.setattr(cells, "SHARE_NUMBERS", share)
    monkeypatch.setattr(cells, "BLOCK_NUMBERS", block)
    monkeypatch.setattr(cells, "SCORE_NUMBERS", scores)
    check_vectors(index, chunks, queries, 20)
    for probes in (None, 2):
        plan = r.vector_candidates(index, queries, 20, probes)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_an_index_reads_its_chunks_once(spark, chunks, tmp_path):
    """Chunks come out of joins; four passes over them ran those joins four times."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    r.write_search_index(chunks.mapInArrow(counted, chunks.schema), str(tmp_path / "i"), 5)
    assert seen.value == chunks.count() > 0


def test_index_reads_back(spark, chunks, queries, tmp_path):
    built = r.write_search_index(chunks, str(tmp_path / "i"), 5)
    again = r.read_search_index(spark, str(tmp_path / "i"))
    assert len(again.centroids) == 5
    one, two = (sorted(map(tuple, r.hybrid_search(i, queries, 3).drop("heading_path").collect())) for i in (built, again))
    assert one == two and one


def test_rows_without_direction_come_last(spark, tmp_path):
    table = spark.createDataFrame(
        [("a", [0.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [1.0, 0.0]), ("n", None)], "chunk_id string, embedding array<float>"
    )
    query = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id int, query_embedding array<float>")
    centroids = cells.train_centroids(table, "chunk_id", "embedding")
    packed = cells.write_cells(cells.nearest_cells(table, "chunk_id", "embedding", centroids), str(tmp_path / "c"))
    found = r.nearest_vectors(packed, centroids, query, 3, key="chunk_id").orderBy("vector_rank").collect()
    assert [(x.query_id, x.chunk_id, x.vector_score) for x in found] == [(1, "c", 1.0), (1, "b", -1.0), (1, "a", None)]


def test_few_cells_find_most_neighbours(spark, tmp_path):
    """Trained cells on the given vectors and on a clustered table: recall against the exact search at the probes stated.

        The given vectors have no clusters, so most cells must be probed; 5% are enough where vectors lie in groups.
        """
    rng = np.random.default_rng(12)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("key"), "embedding")
    centres = rng.standard_normal((60, 32))
    rows = [(int(i), (centres[i % 60] + 0.3 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(6000)]
    clustered = spark.createDataFrame(rows, "key long, embedding array<float>")
    for name, table, share in (("clustered", clustered, 0.05), ("given", given, 0.7)):
        centroids = cells.train_centroids(table, "key", "embedding")
        packed = cells.write_cells(cells.nearest_cells(table, "key", "embedding", centroids), str(tmp_path / name))
        queries = table.where("key % 50 = 0").select(F.col("key").alias("query_id"), F.col("embedding").alias("query_embedding"))
        exact, near = ({(x.query_id, x.key) for x in r.nearest_vectors(packed, centroids, queries, 10, key="key", probes=p).collect()}
                       for p in (None, max(1, round(share * len(centroids)))))
        assert len(exact & near) / len(exact) >= 0.9, name


def test_a_crowded_cell_is_many_rows_and_training_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PACK_NUMBERS", 8 * 100)
    monkeypatch.setattr(cells, "SAMPLE_NUMBERS", 8 * 50)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0] * 8 if i < 2000 else rng.standard_normal(8).astype(float).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "key long, embedding array<float>")
    centroids = cells.train_centroids(table, "key", "embedding")
    assert len(centroids) == 50
    packed = cells.write_cells(cells.nearest_cells(table, "key", "embedding", centroids), str(tmp_path / "c"))
    sizes = packed.select("cell", F.size("keys").alias("n")).collect()
    assert max(s["n"] for s in sizes) <= 100 and sum(s["n"] for s in sizes) == 3000
    query = spark.createDataFrame([(1, [1.0] * 8)], "query_id int, query_embedding array<float>")
    assert [x.key for x in r.nearest_vectors(packed, centroids, query, 5, key="key", probes=1).orderBy("vector_rank").collect()] == [0, 1, 2, 3, 4]


def test_fusion_modes(index, queries):
    lexical, vector = r.lexical_candidates(index, queries, 5), r.vector_candidates(index, queries, 5)
    fused = {(x.query_id, x.chunk_id): x for x in r.rrf_fuse(lexical, vector, candidates=5).collect()}
    for row in fused.values():
        expected = (0.75 / (60 + row.fts_rank) if row.fts_rank else 0) + (0.25 / (60 + row.vector_rank) if row.vector_rank else 0)
        assert row.rrf_score == pytest.approx(expected, abs=1e-8)
    assert any(x.fts_rank and x.vector_rank for x in fused.values())
    only = r.rrf_fuse(lexical, None, "fts", candidates=5).filter("query_id = 0").orderBy("fts_rank").collect()
    assert [x.rrf_score for x in only] == [round(1 / (60 + i), 8) for i in range(1, 6)]
    with pytest.raises(ValueError):
        r.rrf_fuse(lexical, vector, "both")


def test_limits_are_clamped_and_blank_queries_find_nothing(index, queries):
    found = r.hybrid_search(index, queries, limit=50)
    assert found.filter("query_id = 0").count() == 20 and found.filter("query_id IN (2, 4)").count() == 0
    assert r.hybrid_search(index, queries, limit=0).filter("query_id = 0").count() == 1
    text = r.search_excerpt(found).first()
    assert len(text.excerpt) <= 800 and "content" not in text.asDict()


def test_bonus_is_capped(spark):
    df = spark.createDataFrame([([f"t{i}" for i in range(9)], "T1 t2", ["t3 t4", "t5", "t6"])], "terms array<string>, title string, path array<string>")
    assert df.select(r.rerank_bonus(F.col("terms"), F.col("title"), F.col("path"))).first()[0] == pytest.approx(0.0005)


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, ["z"])], "query_id int, gold_titles array<string>")
    results = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "c", 2), (3, "y", 1), (3, "z", 6)], "query_id int, title string, result_rank int")
    row = r.retrieval_eval(results, gold).first()
    assert (row.total, row.recall_at_5, row.mrr, row.top1_accuracy) == (3, 0.6667, 0.5, 0.3333)
    none = r.retrieval_eval(results, gold.filter("FALSE")).first()
    assert (none.total, none.recall_at_5, none.mrr) == (0, 0.0, 0.0)


def test_index_by_sign_code(index, chunks, queries, tmp_path):
    coded, usable = r.write_vector_index(chunks, str(tmp_path / "index"), key="chunk_id", dimensions=64), queries.filter("query_id IN (0, 1, 3)")
    exact = {(x.query_id, x.chunk_id) for x in r.vector_candidates(index, usable, 10).collect()}
    all_codes = {(x.query_id, x.chunk_id) for x in r.vector_candidates_lsh(coded, usable, 10, radius=6, key="chunk_id", dimensions=64).collect()}
    assert all_codes == exact
    near = r.vector_candidates_lsh(coded, usable.limit(1), 10, radius=1, key="chunk_id", dimensions=64)
    assert "cell" in near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_search_log_rows(chunks, index, queries):
    lexical, vector = r.lexical_candidates(index, queries, 5), r.vector_candidates(index, queries, 5)
    results = r.best_results(r.rrf_fuse(lexical, vector), queries, chunks, 5, "hybrid")
    log = {x.query_id: x for x in r.search_log(queries, results, lexical, vector, "hybrid", 1.5).collect()}
    assert log[0].lexical_candidate_count == 5 and len(log[0].result_chunk_ids) == 5
    assert log[4].lexical_candidate_count == 0 and log[4].result_chunk_ids == []


@pytest.mark.skipif("POLICY_DIR" not in os.environ, reason="POLICY_DIR and POLICY_GOLD name a policy corpus")
@pytest.mark.parametrize("mode, expected", [
    ("hybrid", (16, 1.0, 1.0, 1.0)), ("fts", (16, 1.0, 1.0, 1.0)), ("vector", (16, 0.75, 0.5521, 0.4375)),
])
def test_published_retrieval_quality(spark, tmp_path, mode, expected):
    documents, found = ingest_knowledge(spark, read_markdown(spark, os.environ["POLICY_DIR"]), str(tmp_path / "kb"))
    gold = read_gold_jsonl(spark, os.environ["POLICY_GOLD"])
    status = k.knowledge_status(documents, found).first()
    assert (status.document_count, status.chunk_count) == (16, 60)
    index = r.write_search_index(ready_chunks(documents, found), str(tmp_path / "index"))
    results = r.hybrid_search(index, r.prepare_queries(gold), 5, mode)
    assert tuple(r.retrieval_eval(results, gold).first()) == expected


def test_candidates_carry_no_texts(index, queries):
    for found in (r.lexical_candidates(index, queries, 5), r.vector_candidates(index, queries, 5)):
        assert not {"content", "heading_path", "document_id", "low"} & set(found.columns)


def test_word_scores(index, queries):
    every = {(x.query_id, x.chunk_id): x.fts_score for x in r.word_scores(index, queries, None).collect()}
    listed = {(x.query_id, x.chunk_id): x.fts_score for x in r.lexical_candidates(index, queries, 1000).collect()}
    assert every and {k: v for k, v in listed.items() if v > 0} == pytest.approx(every)
    for n in (1, 25):
        best = {(x.query_id, x.chunk_id): x.fts_score for x in r.word_scores(index, queries, n).collect()}
        wanted = {}
        for q in {q for q, _ in every}:
            ranked = sorted((-round(v, 8), c) for (i, c), v in every.items() if i == q)[:n]
            wanted.update({(q, c): -v for v, c in ranked})
        assert best == pytest.approx(wanted)


def test_the_score_query_gives_every_pair(spark, folder):
    """Not the best thirty of each query only."""
    from parcelmart.registry import knowledge

    found = knowledge.jobs()["fts_score"](spark, folder).cache()
    every = r.word_scores(knowledge.index(spark, folder), knowledge.queries(spark, folder), None)
    assert found.count() == every.count() and found.groupBy("query_id").count().agg(F.max("count")).first()[0] > 30


def test_places_of_other_words_are_left_before_any_shuffle(spark, tmp_path):
    rows = [(f"c{i:03}", "d", "t", 0, ["h"], f"w{i} late-fee late Late") for i in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, title string, ordinal int, heading_path array<string>, content string")
    index = postings.write_postings(chunks, str(tmp_path / "p"))
    asked = spark.createDataFrame([("late",), ("w7",)], "word string")
    assert postings.whole_words(index, asked).groupBy("word").agg(F.sum("n").alias("n")).sort("word").collect() == [("late", 300), ("w7", 1)]
    queries = spark.createDataFrame([(1, ["late", "w7"]), (2, ["w7"])], "query_id int, terms array<string>")
    found = {(x.query_id, x.chunk_id): x.fts_score for x in postings.word_scores(index, queries, None).collect()}
    assert len(found) == 101 and found[1, "c007"] == 0.4 and found[1, "c008"] == 0.3 and found[2, "c007"] == 0.1


POLICIES = {
    "returns": "# Returning goods\n\nA customer may send goods back within thirty days.\n\n## Refunds\n\nThe money is refunded to the card.",
    "late": "# Late parcels\n\nA delivery is late after the estimated day.\n\n## Carriers\n\nCarriers are reviewed each quarter.",
    "boxes": "# Packaging rules\n\nFragile goods need a double carton.\n\n## Damage\n\nBroken items are photographed.",
    "sellers": "# Seller onboarding\n\nA merchant signs the contract and names a warehouse.\n\n## Audits\n\nInvoices are audited yearly.",
}
ASKED = [
    ("g1", "goods back within thirty days", "Returning goods"), ("g2", "estimated day of a delivery", "Late parcels"),
    ("g3", "double carton for fragile things", "Packaging rules"), ("g4", "contract and warehouse of a merchant", "Seller onboarding"),
    ("g5", "photographed broken items", "Packaging rules"), ("g6", "invoices audited", "Seller onboarding"),
]


@pytest.mark.parametrize("mode", ["hybrid", "fts", "vector"])
def test_a_policy_corpus_with_known_answers(spark, tmp_path, mode):
    import json

    for stem, text in POLICIES.items():
        (tmp_path / f"{stem}.md").write_text(text, encoding="utf-8")
    lines = [json.dumps({"id": i, "query": q, "gold_titles": [t]}) for i, q, t in ASKED]
    (tmp_path / "gold.jsonl").write_text("\n".join(lines), encoding="utf-8")
    documents, found = ingest_knowledge(spark, read_markdown(spark, str(tmp_path)), str(tmp_path / "kb"))
    status = k.knowledge_status(documents, found).first()
    assert (status.document_count, status.chunk_count, status.embedding_coverage) == (4, 8, 1.0)
    gold = read_gold_jsonl(spark, str(tmp_path / "gold.jsonl"))
    index = r.write_search_index(ready_chunks(documents, found), str(tmp_path / "index"))
    results = r.hybrid_search(index, r.prepare_queries(gold), 5, mode)
    row = r.retrieval_eval(results, gold).first()
    assert row.total == 6 and row.recall_at_5 == 1.0
    assert mode == "vector" or row.top1_accuracy == 1.0


@pytest.mark.parametrize("sizes", [(1 << 23, 8192, 1 << 23, 256), (500, 3, 40, 7)])
def test_many_queries_meet_shares_of_chunks_in_blocks(spark, tmp_path, monkeypatch, sizes):
    """A large batch used to count its terms in the text of every candidate pair: requests of 0.1 GB did not end."""
    from parcelmart.operators import term_blocks

    for name, value in zip(("SHARE_CHARS", "BLOCK_QUERIES", "STEP_SUMS", "TILE"), sizes, strict=True):
        monkeypatch.setattr(term_blocks, name, value)
    monkeypatch.setattr(postings, "MANY_QUERIES", 5)
    monkeypatch.setattr(postings, "_with_hits", None)  # the count in the texts of pairs
    rng = np.random.default_rng(9)
    words = ["parcel", "parcels", "late", "plate", "lat_e", "late-fee", "ab", "a", "b", "运费成本", "ÉTÉ", "x1", "latte", "a-b", "Late"]
    rows = [(f"c{i:03}", f"d{i // 3}", " ".join(rng.choice(words, 2)) if i % 4 else "the late title", i % 3, ["h"],
             " ".join(rng.choice(words, rng.integers(0, 9))) + "." * (i % 3)) for i in range(200)]
    chunks = spark.createDataFrame(
        rows, "chunk_id string, document_id string, title string, ordinal int, heading_path array<string>, content string")
    texts = ["late", "parcel late a_b", "la_e plate", "运费 ab x1", "late-fee été", "nowhere", "a_ b1 lat", "title the", "ab _ __ a__"]
    asked = r.prepare_queries(spark.createDataFrame(list(enumerate(texts)), "query_id int, query string"), dimensions=64)
    built = r.SearchIndex(chunks, postings.write_postings(chunks, str(tmp_path / "p")), None, None)
    for n in (2, 30):
        check_lexical(built, asked, n)
    plain = {(x.query_id, x.chunk_id): x for x in r.lexical_candidates(built, asked, 30).collect()}
    for (query, chunk), x in plain.items():
        text = next(c for c in rows if c[0] == chunk)
        assert x.lexical_hits >= x.title_hits and x.title == text[2]


def test_a_title_that_is_null_has_no_terms_in_a_large_batch(spark, monkeypatch):
    from parcelmart.operators.term_blocks import search_blocks

    chunks = spark.createDataFrame([("a", None, 0, "late late"), ("b", "late", 0, None)], "chunk_id string, title string, ordinal int, content string")
    asked = spark.createDataFrame([(1, ["late", "x" * 3]), (None, ["late"])], "query_id int, terms array<string>")
    found = sorted(tuple(x) for x in search_blocks(chunks, asked, 5).drop("title").collect())
    assert found == [(1, "a", 0, 0, 1, 2), (1, "b", 0, 1, 1, 0)]


def test_parts_are_written_when_a_search_follows_words(chunks, queries, tmp_path, monkeypatch):
    """Every index used to write the words of all chunks by their grams, also for vectors and for batches that read the texts."""
    built = r.write_search_index(chunks, str(tmp_path / "i"), 5, parts=False)
    assert r.vector_candidates(built, queries, 5).count() > 0
    scores = [sorted(map(tuple, r.word_scores(built, queries, n).collect())) for n in (None, 4)]
    monkeypatch.setattr(postings, "MANY_QUERIES", 1)
    many = sorted(map(tuple, r.lexical_candidates(built, queries, 5).collect()))
    assert sorted(x.name for x in (tmp_path / "i" / "postings").iterdir()) == ["chunks"]
    monkeypatch.setattr(postings, "MANY_QUERIES", 1000)
    assert sorted(map(tuple, r.lexical_candidates(built, queries, 5).collect())) == many
    assert sorted(x.name for x in (tmp_path / "i" / "postings").iterdir()) == sorted(["chunks", *postings.PARTS])
    assert [sorted(map(tuple, r.word_scores(built, queries, n).collect())) for n in (None, 4)] == scores and all(scores)


def test_terms_are_found_in_many_texts_at_once(monkeypatch):
    import re

    from parcelmart.operators import term_blocks

    monkeypatch.setattr(term_blocks, "SLICE_CHARS", 50)
    rng = np.random.default_rng(4)
    letters = list("ab-_ é运𝔘\0\n1")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(200)] + ["x" * 40 + "a" * 50, "", "ab"]
    terms = sorted({"".join(rng.choice(letters, rng.integers(1, 4))) for _ in range(150)} | {"a" * 40, "a" * 33, "x" * 40 + "a", "a" * 33 + "b", "ab a"})
    (text, term), (at, word, _) = term_blocks._holds(texts, terms)
    like = {t: re.compile(".".join(map(re.escape, t.split("_"))), re.DOTALL) for t in terms}
    assert set(zip(text.tolist(), term.tolist())) == {(i, j) for i, x in enumerate(texts) for j, t in enumerate(terms) if like[t].search(x)}
    whole = [(i, terms.index(w)) for i, x in enumerate(texts) for w in re.findall(r"[^\W_]+", x) if w in like]
    assert sorted(zip(at.tolist(), word.tolist())) == sorted(whole)
    assert list(text) == sorted(text) and list(at) == sorted(at)


@pytest.mark.parametrize("n, group", [(1, 16), (7, 3), (40, 2), (500, 16)])
def test_single_floats_only_choose_what_is_multiplied_in_full(monkeypatch, n, group):
    monkeypatch.setattr(cells, "GROUP", group)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    vectors, known = cells.unit(np.concatenate([base, base[:20], base + 1e-7 * rng.standard_normal(base.shape), np.zeros((5, 24)), -base]))
    queries, place = cells.unit(base + 1e-6)[0], rng.permutation(len(vectors))
    query, row, score = cells._exact_best(queries, vectors, vectors.astype(np.float32), known, n, place)
    every = np.round(np.einsum("ik,jk->ij", queries, vectors), 8) + 0.0
    every[:, ~known] = -2.0
    for i in range(len(queries)):
        order = np.lexsort((place, -every[i]))[:n]
        assert np.allclose(score[query == i], every[i][order], atol=2e-8)
        if n > 1:
            assert set(row[query == i][:n // 2]) <= set(np.lexsort((place, -every[i]))[:n + 3])
