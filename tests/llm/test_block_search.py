from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from parcelmart.llm import block_search as b
from tests.conftest import SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def slow_search(docs, items, k):
    """{(item_id, text): [(doc_id, score)]}, every document scored for every item."""
    counted = [(i, Counter(WORD.findall((t or "").translate(LOWER)))) for i, t in docs]
    total = sum(sum(c.values()) for _, c in counted)
    n = sum(1 for _, c in counted if c)
    df = Counter(w for _, c in counted for w in c)
    out = {}
    for item, text in set(items):
        asked = Counter(WORD.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // total if c else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                    for w, q in asked.items() if c[w])
            if s > 0:
                scores.append((-s, i is None, i))
        out[item, text] = [(i, -s) for s, _, i in sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


@pytest.mark.parametrize("documents", [4096, 40])
@pytest.mark.parametrize("limit", [1 << 18, 2000])
def test_given_tables_equal_brute_force(spark, monkeypatch, documents, limit):
    monkeypatch.setattr(b, "SHARD_DOCUMENTS", documents)
    monkeypatch.setattr(b, "BLOCK_DOCUMENTS", 64 if documents == 4096 else 4)
    monkeypatch.setattr(b.item_blocks, "__defaults__", (limit,))
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    truth = slow_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert found(b.ranked_search(docs, items)) == {i: t for (i, _), t in truth.items() if t}


def test_ties_repeats_nulls_and_odd_texts(spark):
    rng = random.Random(2)
    words = ["the", "The", "été", "ÉTÉ", "x1", "a_b", "zebra", "运费", " ", "K", "ſ", "9"]
    docs = [(rng.choice([i, i, i, None, 7]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "the\x00zebra " * 3000), (1003, "\t \n"), (1004, "zebra"), (1004, "zebra"), (5, "zebra")]
    items = [(1, "zebra été"), (2, "The the 运费 a_b"), (3, None), (4, ""), (5, "nowhere"), (None, "x1 k 9"), (1, "zebra été"), (6, "zebra " * 9)]
    frames = [spark.createDataFrame([(*r, 1) for r in rows], f"{key} long, text string, rank int")
              for rows, key in ((docs, "doc_id"), (items, "item_id"))]
    truth = slow_search(docs, items, 20)
    assert found(b.ranked_search(frames[0].repartition(4), frames[1])) == {i: t for (i, _), t in truth.items() if t}
    none = [f.where("false") for f in frames]
    assert b.ranked_search(none[0], frames[1]).collect() == [] and b.ranked_search(frames[0], none[1]).collect() == []


def test_blocks_are_skipped_and_bounds_hold():
    """Lists are cut into blocks, summaries are their maxima, most blocks are skipped, and the best documents stay the same."""
    rng = np.random.default_rng(6)
    words = [f"w{i}".encode() for i in range(400)]
    topics = [rng.permutation(400) for _ in range(12)]
    docs = [Counter(words[t] for t in topics[rng.integers(12)][np.minimum(rng.geometric(0.03, 60), 399)]) for _ in range(3000)]
    items = b.Items(list(range(30)), [Counter(list(docs[i])[:12]) for i in range(30)])
    terms = items.vocabulary()
    df = np.array([sum(t in d for d in docs) for t in terms])
    items = items.ordered(terms, b.term_weights(df, len(docs)))
    number = {t: i for i, t in enumerate(items.terms)}
    rows = [[(number[t], 10**9 * n // (1000 * n + 1200)) for t, n in d.items() if t in number] for d in docs]
    shard = b.build_shard(np.arange(3000), np.ones(3000, bool), np.array([len(r) for r in rows]), np.array([t for r in rows for t, _ in r]),
                          np.array([p for r in rows for _, p in r]), items.weights, items.coordinates())
    dense, at, cell = shard.dense(len(terms)), 0, 0
    sizes = iter(shard.block_sizes)
    for term, wide in enumerate(items.coordinates()):
        for _ in range(shard.blocks[term]):
            size = next(sizes)
            some = shard.listed[at:at + size]
            assert (dense[some, term] > 0).all()
            assert (dense[some][:, wide].max(axis=0) == shard.maxima[cell:cell + len(wide)]).all()
            at, cell = at + size, cell + len(wide)
    assert at == (dense > 0).sum()
    search = b.Search(items, 20)
    search.add(shard)
    for (some, weights), (scores, ids, _) in zip(items.vectors(), search.best, strict=True):
        value = dense[:, some].astype(np.int64) @ weights
        order = np.lexsort((np.arange(3000), -value))[:20]
        assert (value[order] == scores).all() and (order == ids).all()
    assert search.skipped > sum(shard.blocks[t] for s, _ in items.vectors() for t in s) / 3
