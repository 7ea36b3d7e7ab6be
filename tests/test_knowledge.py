from __future__ import annotations

import hashlib
import math
import random
import re

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelmart.functions.tokens import python_tokens, tokenize
from parcelmart.functions import vectors
from parcelmart.functions.vectors import cosine_similarity, hash_embedding
from parcelmart.operators import knowledge as k
from parcelmart.plans.ingest import ingest_knowledge, ready_chunks


def chunks(spark, text, **more):
    df = spark.createDataFrame([("d", "t", text, "h")], "document_id string, title string, text string, content_hash string")
    return [(r.ordinal, list(r.heading_path), r.content) for r in k.chunk_documents(df, **more).orderBy("ordinal").collect()]


def test_heading_path_cuts_and_nests_without_padding(spark):
    text = "intro\n### deep\na\n## second\nb\n# top\nc\n## sub\n\n\n#### jump\nd\n## next\ne"
    assert chunks(spark, text) == [
        (0, [], "intro"), (1, ["deep"], "a"), (2, ["deep", "second"], "b"), (3, ["top"], "c"),
        (4, ["top", "sub", "jump"], "d"), (5, ["top", "next"], "e"),
    ]


def test_what_is_no_heading(spark):
    assert chunks(spark, "#tag\n####### seven\n # indented\n#\nx") == [(0, [], "#tag\n####### seven\n # indented\n#\nx")]
    assert chunks(spark, "```\n# in code\n```") == [(0, [], "```"), (1, ["in code"], "```")]
    assert chunks(spark, "# a\r\nx\ry z") == [(0, ["a"], "x\ny\nz")]
    assert chunks(spark, " \n \n") == []


def slow_pack(body, limit, sep):
    done, buffer = [], ""
    for part in body.split(sep):
        longer = (buffer + sep + part).strip()
        if buffer and len(longer) > limit:
            done.append(buffer)
            buffer = part
        else:
            buffer = longer
    return done + ([buffer] if buffer else [])


def test_packing_against_a_plain_loop(spark):
    rng = random.Random(3)
    for sep in ("\n\n", "\n"):
        parts = ["".join(rng.choice("ab \n中") for _ in range(rng.randint(0, 30))) for _ in range(60)]
        body = sep.join(parts).strip()
        found = [c for _, _, c in chunks(spark, body, target_chars=50, sep=sep)]
        assert found == slow_pack(body, 50, sep)


def test_chunk_hash_and_token_count(spark):
    df = spark.createDataFrame([("d", "t", "# h\n" + "x" * 7, "abc")], "document_id string, title string, text string, content_hash string")
    row = k.chunk_documents(df).first()
    assert row.chunk_id == hashlib.sha256(b"abc:0:xxxxxxx").hexdigest() and row.token_count == 2


def test_title_and_dedup(spark):
    files = spark.createDataFrame(
        [("a", "a.md", "no heading"), ("b", "b.md", "x\n## Two \ny"), ("c", "c.md", "no heading"), ("d", "d.md", "#\nspan over")],
        "stem string, filename string, text string",
    )
    found = {r.filename: r.title for r in k.knowledge_documents(files, "filename").collect()}
    assert found == {"b.md": "Two", "c.md": "c", "d.md": "span over"}


def test_many_copies_of_one_text(spark):
    copies = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text")
    )
    kept = k.dedup_documents(copies, "id")
    assert kept.count() == 6001
    assert kept.filter("text = 'same'").first().id == 8997


TEXT = "Delivery-late ＡＢＣ x 配送延期异常 运费 a1_b"


def test_tokens(spark):
    expected = ["delivery-late", "abc", "a1_b", "配送", "送延", "延期", "期异", "异常", "配送延", "送延期", "延期异",
                "期异常", "配送延期", "送延期异", "延期异常", "运费", "运费"]
    df = spark.createDataFrame([(TEXT,)], "t string")
    assert df.select(tokenize("t")).first()[0] == expected
    assert python_tokens(TEXT) == expected


def slow_embedding(text, dims):
    counts = {}
    for token in python_tokens(text):
        counts[token] = counts.get(token, 0) + 1
    v = [0.0] * dims
    for token, n in counts.items():
        d = hashlib.blake2b(token.encode(), digest_size=16).digest()
        v[int.from_bytes(d[:8], "little") % dims] += (1 if d[8] % 2 else -1) * (1 + math.log(1 + n))
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def test_embedding_is_unit_length_deterministic_and_as_defined(spark):
    texts = [TEXT, "late delivery of parcels", "late delivery parcels", "packaging check", "", "?!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r.i: r.v for r in df.select("i", hash_embedding("t", 128).alias("v")).collect()}
    for i, text in enumerate(texts):
        assert found[i] == pytest.approx(slow_embedding(text, 128), abs=1e-7)
    assert sum(x * x for x in found[0]) == pytest.approx(1, abs=1e-6)
    assert set(found[4]) == {0.0}
    dot = lambda a, b: sum(x * y for x, y in zip(found[a], found[b], strict=True))
    assert dot(1, 2) > dot(1, 3)
    with pytest.raises(ValueError):
        hash_embedding("t", 16)


def test_long_batches_are_embedded_in_slices(spark):
    """A batch of texts used to be held as tokens all at once."""
    texts = pd.Series(["a" * 10, None, "b" * vectors.SLICE_CHARS, "c", "d" * (vectors.SLICE_CHARS - 1), "e", "f"])
    parts = list(vectors._slices(texts))
    assert [list(p.index) for p in parts] == [[0, 1], [2], [3, 4], [5, 6]]
    assert list(vectors._slices(texts.iloc[:0])) == []
    long = " ".join(f"w{i}" for i in range(90_000))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([long, "late parcels", long, None, long, "late parcels"])], "i int, t string").coalesce(1)
    found = {r.i: r.v for r in df.select("i", hash_embedding("t", 32, "md5").alias("v")).collect()}
    assert found[0] == found[2] == found[4] and found[1] == found[5] and any(found[1]) and set(found[3]) == {0.0}
    assert found[0] == pytest.approx(vectors.embed_token_lists(pd.Series([long.split()]), 32, "md5")[0], abs=1e-7)


def test_deduplication_moves_texts_once(spark):
    """Once for the join; a second shuffle of the texts that are left is not needed."""
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (2, "a", "z"), (None, "b", "x"), (None, "b", "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "n int, text string, stem string").repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = k.dedup_documents(df, "n")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        found = sorted((r.text, r.n) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == [("a", 2), ("b", None)]
    assert plan.count("hashpartitioning(content_hash") == 3


def test_chunks_are_dealt_by_document_once(spark, tmp_path):
    """The latest batch and the ready documents were two shuffles of all chunks."""
    files = spark.createDataFrame([("a.md", "a", "one two"), ("b.md", "b", "# H\n\nthree"), ("c.md", "a", "one two")], "filename string, stem string, text string")
    first = ready_chunks(*ingest_knowledge(spark, files, str(tmp_path / "kb"), dimensions=32))
    again = ready_chunks(*ingest_knowledge(spark, files.limit(1), str(tmp_path / "kb"), dimensions=32))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert sorted(x.content for x in again.collect()) == sorted(x.content for x in first.collect()) == ["one two", "three"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") == 6  # chunks once, documents twice, batches three times


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    row = df.select(cosine_similarity(F.col("a"), F.col("b")), cosine_similarity(F.col("a"), F.col("z"))).first()
    assert row[0] == pytest.approx(math.sqrt(0.5)) and row[1] == 0.0
    with pytest.raises(PySparkException):
        df.select(cosine_similarity(F.col("a"), F.col("s"))).collect()


def test_ingestion_replaces_and_reports(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "a", "# A\none\n\n" + "y" * 600), ("b.md", "b", "two")], "filename string, stem string, text string")
    documents, found = ingest_knowledge(spark, files, str(tmp_path), dimensions=64)
    documents, found = ingest_knowledge(spark, files, str(tmp_path), dimensions=64)
    status = k.knowledge_status(documents, found).first()
    assert (status.chunk_count, status.embedded_chunk_count, status.document_count, status.embedding_coverage) == (3, 3, 2, 1.0)
    assert [(r.title, r.chunk_count) for r in k.list_documents(documents, found).collect()] == [("A", 2), ("b", 1)]
    assert {r.status for r in documents.collect()} == {"ready"} and ready_chunks(documents, found).count() == 3
    assert re.fullmatch("[0-9a-f]{64}", documents.first().document_id)
    empty = found.filter("FALSE")
    assert k.knowledge_status(documents, empty).first().embedding_coverage == 0.0


def test_dedup_with_equal_and_missing_order(spark):
    rows = [("a", 1, "same"), ("b", 1, "same"), ("c", None, "alone"), ("d", None, "late"), ("e", 5, "late"), ("f", 2, "x"), ("f", 2, "x")]
    kept = k.dedup_documents(spark.createDataFrame(rows, "stem string, n int, text string"), "n")
    found = sorted((r.text, r.stem) for r in kept.collect())
    assert [t for t, _ in found] == ["alone", "late", "same", "x"] and ("late", "e") in found


def test_a_second_load_keeps_the_first(spark, tmp_path):
    def load(*files):
        frame = spark.createDataFrame(list(files), "filename string, stem string, text string")
        return ingest_knowledge(spark, frame, str(tmp_path), dimensions=64)

    load(("a.md", "a", "# A\none"), ("b.md", "b", "two"))
    documents, found = load(("b2.md", "b2", "two"), ("a.md", "a", "# A\none, edited"))
    assert sorted((r.title, r.stem) for r in documents.collect()) == [("A", "a"), ("A", "a"), ("b2", "b2")]
    assert found.count() == 3 and ready_chunks(documents, found).count() == 3
    assert k.list_documents(documents, found).filter("source_url = 'seed://b2' AND chunk_count = 1").count() == 1


def test_chunks_of_absent_or_pending_documents_are_not_ready(spark):
    documents = spark.createDataFrame([("d1", "ready"), ("d2", "embedding")], "document_id string, status string")
    chunks = spark.createDataFrame([("d1", 1), ("d2", 2), ("gone", 3)], "document_id string, n int")
    assert [r.n for r in ready_chunks(documents, chunks).collect()] == [1]


def test_one_batch_is_read_without_a_join(spark, tmp_path):
    """Texts and vectors used to be shuffled to find each document's latest batch, also where there is only one."""
    from parcelmart.plans.ingest import pending_documents

    def load(*files):
        return ingest_knowledge(spark, spark.createDataFrame(list(files), "filename string, stem string, text string"), str(tmp_path), dimensions=32)

    read = lambda *frames: ["Join" in f._jdf.queryExecution().executedPlan().toString() for f in frames]
    documents, found = load(("a.md", "a", "# A\none"), ("b.md", "b", "two"))
    assert read(documents, found, pending_documents(spark, str(tmp_path))) == [False] * 3
    assert sorted(x.content for x in found.collect()) == ["one", "two"] and documents.count() == 2
    (tmp_path / "chunks" / "batch=9-failed").mkdir()
    found.limit(1).write.mode("append").parquet(str(tmp_path / "chunks" / "batch=9-failed"))
    from parcelmart.plans.ingest import read_knowledge

    assert read_knowledge(spark, str(tmp_path))[1].count() == 2  # chunks of a load that failed stay out
    documents, found = load(("c.md", "c", "two"))
    assert read(documents, found) == [True] * 2 and found.count() == 2
