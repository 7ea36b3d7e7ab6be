from __future__ import annotations

import numpy as np
import pytest

from parcelmart.llm import small_world as w

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, queries, k):
    """{query_id: [(vec_id, cosine)]} over all pairs."""
    ids = np.array([i for i, _ in rows])
    points = w.unit(np.array([v for _, v in rows], np.float32).astype(float))
    out = {}
    for i, v in queries:
        value = points @ w.unit(np.array([v], np.float32).astype(float))[0]
        best = sorted((-round(s, 12), j) for s, j in zip(value.tolist(), ids.tolist(), strict=True) if j != i)[:k]
        out[i] = [(j, -s) for s, j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, truth):
    """Share of true neighbours returned; an equal cosine counts, whichever of the equal rows it names."""
    hits = sum(sum(score >= truth[q][-1][1] - 1e-9 for _, score in got.get(q, [])) for q in truth)
    return hits / sum(len(t) for t in truth.values())


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_table(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    queries = [r for r in rows if r[0] % 50 == 0]
    truth = exact(rows, queries, 5)
    got = found(w.nearest_neighbours(table, table.where("vec_id % 50 = 0"), 5, shard_numbers=64 * 1500))
    assert set(got) == set(truth) and all(len(g) == 5 for g in got.values())
    assert recall(got, truth) >= 0.95
    scores = {(q, i): s for q, t in exact(rows, queries[:5], len(rows)).items() for i, s in t}
    assert all(abs(scores[q, i] - s) < 1e-9 for q, _ in queries[:5] for i, s in got[q])


def test_copies_near_copies_and_ties(spark):
    """A third of all rows hold one vector, another third lie about one: all found, ties to the smaller id."""
    rng = np.random.default_rng(3)
    one, other = rng.standard_normal((2, 16)).astype(np.float32)
    rows = [(i, one.tolist()) for i in range(600)]
    rows += [(i, (other + 1e-3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(600, 1200)]
    rows += [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(1200, 1800)]
    queries = [r for r in rows if r[0] % 50 == 0]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = found(w.nearest_neighbours(frame, frame.where("vec_id % 50 = 0"), 5, shard_numbers=16 * 500))
    truth = exact(rows, queries, 5)
    assert recall(got, truth) >= 0.95
    for q in range(50, 600, 50):
        assert [i for i, _ in got[q]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]


def test_small_graphs_are_exact(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 60):
        rows = [(50 * i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(n)]
        frame = spark.createDataFrame(rows, SCHEMA)
        got, truth = found(w.nearest_neighbours(frame, frame, 5)), exact(rows, rows, 5)
        assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in t] for q, t in truth.items() if t}


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (None, [1.0, 0.0]), (50, [0.0, 3.0]), (50, [0.0, 3.0]), (100, [1.0, 1.0, 1.0]), (8, [-0.0, -1.0]), (150, [0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", embedding_2 string, shard int")
    got = found(w.nearest_neighbours(frame, frame.where("vec_id % 50 = 0"), 5))
    assert got == {0: [(1, 1.0), (8, 0.0), (50, 0.0)], 50: [(0, 0.0), (1, 0.0), (8, -1.0)]}
    none = spark.createDataFrame([], SCHEMA)
    assert w.nearest_neighbours(none, none).collect() == [] and w.nearest_neighbours(frame, none).collect() == []


def test_stored_graph_reads_back_as_built():
    points = np.random.default_rng(8).standard_normal((300, 8))
    layers = w.build_graph(points)
    assert [len(n) for n, _ in layers] == sorted(len(n) for n, _ in layers) and len(layers[-1][0]) == 300
    for nodes, links in layers:
        assert links.max() < len(nodes) and (np.sort(nodes) == nodes).all()
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(links))
