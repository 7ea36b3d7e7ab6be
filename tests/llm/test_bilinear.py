"""Base scores against plain sums, and the model against the unigram on held-out texts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from parcelmart.llm import bilinear, queries


def plain(rows):
    counts, out = Counter(), []
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    tokens = [[w for w in (r[1] or "").encode().lower().split()] + [None] for r in rows]
    for t, h in zip(tokens, held, strict=True):
        if not h:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for r, t, h in zip(rows, tokens, held, strict=True):
        out.append((r[0], h, len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)))
    return out


def same(found, want):
    order = lambda r: (str(r[0]), r[2], r[5])
    found, want = sorted(found, key=order), sorted(want, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in found], [r[5] for r in want])


def test_scores_on_the_small_tables(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    same([tuple(r)[:6] for r in queries.op9_log_bilinear_scores(spark, folder).collect()], plain(rows))


def test_the_join_gives_the_same_as_the_head(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for head in (0, 300):
        same([tuple(r)[:6] for r in bilinear.score_texts(docs, head).collect()], plain(rows))


def test_held_out_texts_score_better_than_unigram(spark):
    found = queries.op9_log_bilinear_scores(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert found["score"].sum() > found["base_score"].sum()


def test_the_files_of_a_table_do_not_change_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bilinear, "shard_count", lambda tokens: 3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(5)).select("doc_id", "text"))
    scores = []
    for files in (1, 16):
        docs.repartition(files).write.parquet(f"{tmp_path}/{files}")
        found = bilinear.score_texts(spark.read.parquet(f"{tmp_path}/{files}")).toPandas()
        scores.append(found.sort_values(["doc_id", "score"])["score"].to_numpy())
    assert np.allclose(*scores, rtol=1e-6, atol=0)  # matrix products of 32 bits round by batch


def test_equal_rows_are_dealt_over_shards(spark):
    docs = spark.createDataFrame([(1, "a")] * 23 + [(None, None)] * 2 + [(2, "b")], "doc_id int, text string")
    found = [[(r["whole_text"], r["times"]) for r in part] for part in bilinear.dealt(docs, 4).rdd.glom().collect()]
    totals = Counter()
    for text, times in (r for part in found for r in part):
        totals[None if text is None else bytes(text)] += times
    assert totals == {b"a": 23, None: 2, b"b": 1}
    shards = bilinear.dealt(docs, 4).where("whole_text = 'a'").collect()
    assert sorted(r["shard"] for r in shards) == [0, 1, 2, 3] and {r["times"] for r in shards} == {5, 6}
    assert bilinear.dealt(docs, 1).count() == 3


def test_classes_add_to_one():
    rng = np.random.default_rng(0)
    counts = np.sort(rng.integers(1, 500, 600))[::-1]
    model = bilinear.Model({str(i).encode(): i for i in range(600)}, counts, int(counts.sum()) + 40, 601, 40)
    before = rng.integers(0, model.end + 1, (500, bilinear.CONTEXT))
    classes = rng.integers(0, model.end + 1, 500)
    state = {k: np.zeros_like(v) for k, v in model.parameters.items()}
    model.train(classes, before, state, rng)
    total = sum(10 ** model.log10_classes(np.full(500, c), before) for c in range(model.end + 1))
    assert np.allclose(total, 1, atol=1e-4)


def test_edges(spark):
    rows = [(None, "a b A"), (1, None), (1, ""), (2, "A a b"), (2, "A a b"), (11, "zzz")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    same([tuple(r)[:6] for r in bilinear.score_texts(docs).collect()], plain(rows))
    assert bilinear.score_texts(docs.limit(0)).count() == 0
    alone = [(i, "x y") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    found = bilinear.score_texts(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in found)


def test_words_beyond_the_most_frequent_are_told_apart():
    """Word 300 + k is always followed by word 600 + k, all of them equally rare: the model learns which."""
    rng = np.random.default_rng(1)
    counts = np.concatenate((np.full(300, 2000), np.full(600, 100)))
    model = bilinear.Model({str(i).encode(): i for i in range(900)}, counts, int(counts.sum()) + 1000, 901, 1000)
    first = rng.integers(300, 600, 30_000)
    texts = np.stack([rng.integers(0, 300, len(first)), first, first + 300, np.full(len(first), model.end)], axis=1)
    before = np.full((*texts.shape, bilinear.CONTEXT), model.end)
    for place in range(3):
        for j in range(place + 1):
            before[:, place + 1, j] = texts[:, place - j]
    state = {k: np.zeros_like(v) for k, v in model.parameters.items()}
    start = model.log10_classes(texts[:, 2], before[:, 2]).mean()
    for _ in range(4):
        model.train(texts.ravel(), before.reshape(-1, bilinear.CONTEXT), state, rng)
    right = model.log10_classes(texts[:, 2], before[:, 2]).mean()
    wrong = model.log10_classes(np.roll(texts[:, 2], 1), before[:, 2]).mean()
    assert right > start + 0.5 and right > wrong + 0.5


def test_buckets_and_unseen_words_add_to_one():
    model = bilinear.Model({b"a": 0}, np.array([5]), 40, 30, 4, np.array([20, 11]), np.array([20, 8]))
    shares = [(20 + 0.5 * 20 + 0.5) / model.bucket_mass[0], (11 + 0.5 * 8 + 0.5) / model.bucket_mass[1]]
    assert np.allclose(shares, 1)
    total = sum(10 ** model.log10_classes(np.full(3, u), np.zeros((3, bilinear.CONTEXT), np.int64)) for u in range(model.end + 1))
    assert np.allclose(total, 1, atol=1e-4)
