"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one node that carries its smallest ids, so a vector held by a third of all rows is one node (ids are cut to the
few that can be asked for by Spark's limit on ranked rows, before the shuffle). Distinct vectors are dealt to shards by hash. A shard's
graph is flat: per layer the node numbers and a matrix of neighbours, -1 where there is none. Nodes enter a layer in batches: one beam search for
all of a batch over what is there, together with the batch itself, then links to a spread-out choice of the
candidates, and back. Every query visits every shard, in blocks of queries joined to shards by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelmart.llm.texts import limit_batches, written

LINKS = 16  # of a node in the upper layers; twice as many in the lowest
BUILD_BEAM = 64
SEARCH_BEAM = 160
UPPER_BEAM = 8
SHARD_NUMBERS = 1 << 19  # components of all vectors of a shard
QUERY_NUMBERS = 1 << 17  # components of all vectors of a block of queries
ROWS_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 21  # pairs of candidates compared at once
SEED = 17


# --- one graph ---------------------------------------------------------------------------------------------


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by the largest component first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def beam(points: np.ndarray, links: np.ndarray, asked: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per asked vector the ``width`` nearest nodes that a best-first walk from ``entries`` meets: (nodes, cosines), nearest first.

    All walks take a step together; -1 fills lists that are short.
    """
    n = len(asked)
    seen = np.zeros((n, len(points)), bool)
    nodes = np.full((n, width), -1, np.int64)
    near = np.full((n, width), -np.inf, np.float32)
    done = np.zeros((n, width), bool)
    first = min(width, entries.shape[1])
    nodes[:, :first] = entries[:, :first]
    present = nodes[:, :first] >= 0
    near[:, :first] = np.where(present, np.einsum("qed,qd->qe", points[nodes[:, :first]], asked), -np.inf)
    rows, _ = np.nonzero(present)
    seen[rows, nodes[:, :first][present]] = True
    active = np.arange(n)
    while len(active):
        open_near = np.where(done[active], -np.inf, near[active])
        pick = open_near.argmax(axis=1)
        going = open_near[np.arange(len(active)), pick] > -np.inf
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        ahead = links[nodes[active, pick]]
        fresh = (ahead >= 0) & ~seen[active[:, None], ahead]
        who, column = np.nonzero(fresh)
        found = ahead[who, column]
        seen[active[who], found] = True
        value = np.full(ahead.shape, -np.inf, np.float32)
        value[who, column] = np.einsum("ij,ij->i", points[found], asked[active[who]])
        all_near = np.concatenate([near[active], value], axis=1)
        all_nodes = np.concatenate([nodes[active], ahead], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        near[active] = np.take_along_axis(all_near, best, 1)
        nodes[active] = np.take_along_axis(all_nodes, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1) | (near[active] == -np.inf)
    nodes[near == -np.inf] = -1
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)


def spread_out(points: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (nearest first, -1: none): those nearer to the row's own point than to any
    chosen before, then the nearest of the others."""
    rows, width = candidates.shape
    if rows > 1 and rows * width * width > PAIRS_AT_ONCE:
        half = rows // 2
        return np.concatenate([spread_out(points, candidates[r], near[r], most) for r in (slice(half), slice(half, None))])
    vectors = points[candidates]
    between = vectors @ vectors.transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    closest = np.full((rows, width), -np.inf, np.float32)  # to any chosen one
    for j in range(width):
        take = (candidates[:, j] >= 0) & (near[:, j] > closest[:, j]) & (count < most)
        chosen[:, j] = take
        count += take
        closest[take] = np.maximum(closest[take], between[take, j])
    rank = np.where(candidates < 0, 2, np.where(chosen, 0, 1)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    return np.take_along_axis(candidates, order, 1)


def _linked_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, most: int) -> None:
    """Every neighbour of the ``new`` nodes gets a link back; lists that are too long are chosen anew."""
    source = np.repeat(new, links.shape[1])
    target = links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    touched, start, count = np.unique(target, return_index=True, return_counts=True)
    for at in range(0, len(touched), ROWS_AT_ONCE):
        some, begin, n = touched[at:at + ROWS_AT_ONCE], start[at:at + ROWS_AT_ONCE], count[at:at + ROWS_AT_ONCE]
        wide = np.full((len(some), most + n.max()), -1, np.int64)
        wide[:, :most] = links[some]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide[np.repeat(np.arange(len(some)), n), most + offset] = source[np.repeat(begin, n) + offset]
        order = np.argsort(wide, axis=1)
        ranked = np.take_along_axis(wide, order, 1)
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1  # linked both ways within the batch
        near = np.where(ranked >= 0, np.einsum("rcd,rd->rc", points[ranked], points[some]), -np.inf).astype(np.float32)
        order = np.argsort(-near, axis=1, kind="stable")
        links[some] = spread_out(points, np.take_along_axis(ranked, order, 1), np.take_along_axis(near, order, 1), most)


def build_graph(vectors: np.ndarray, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top: (nodes of the layer, their neighbours as places in that list). The last layer has all nodes."""
    points = unit(vectors).astype(np.float32)
    draws = np.random.default_rng(seed).random(len(points))
    levels = np.floor(-np.log1p(-draws) / np.log(LINKS)).astype(np.int64)
    levels[0] = max(levels.max(), 0)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(levels.max(), -1, -1):
        nodes = np.flatnonzero(levels >= level)
        own, most = points[nodes], LINKS * (2 if level == 0 else 1)
        links = np.full((len(nodes), most), -1, np.int64)
        at = 0
        while at < len(nodes):
            size = min(len(nodes) - at, ROWS_AT_ONCE, max(at // 2, 2 * LINKS))
            new = np.arange(at, at + size)
            among = own[new] @ own[new].T
            np.fill_diagonal(among, -np.inf)
            candidates, near = np.broadcast_to(new, among.shape), among
            if at:
                entries = descend(points, layers, own[new], nodes)
                entries = np.where(entries < at, entries, -1)
                entries = np.concatenate([entries, np.zeros((size, 1), np.int64)], axis=1)  # place 0 is in every layer
                entries[:, :-1][entries[:, :-1] == 0] = -1
                found, value = beam(own[:at], links[:at], own[new], entries, max(BUILD_BEAM, most))
                candidates, near = np.concatenate([found, candidates], axis=1), np.concatenate([value, near], axis=1)
            order = np.argsort(-near, axis=1, kind="stable")[:, :max(BUILD_BEAM, most)]
            near = np.take_along_axis(near, order, 1)
            candidates = np.where(near == -np.inf, -1, np.take_along_axis(candidates, order, 1))
            chosen = spread_out(own, candidates, near, most // 2 if at else most)
            links[new, :chosen.shape[1]] = chosen
            _linked_back(own, links, new, most)
            at += size
        layers.append((nodes, links))
    return layers


def descend(points: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Entries for the layer whose nodes are ``below``: the nearest nodes met in the layers above, as places in ``below``."""
    entries = np.zeros((len(asked), 1), np.int64)
    for i, (nodes, links) in enumerate(layers):
        found, _ = beam(points[nodes], links, asked, entries, min(UPPER_BEAM, len(nodes)))
        under = layers[i + 1][0] if i + 1 < len(layers) else below
        entries = np.where(found >= 0, np.searchsorted(under, nodes[found]), -1)
    return entries


def search_graph(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, n: int, width: int = SEARCH_BEAM):
    """(nodes, cosines in double precision) of the ``n`` nearest found per asked vector; -1 and -inf fill short lists."""
    points, targets = unit(vectors), unit(asked)
    small, wanted = points.astype(np.float32), targets.astype(np.float32)
    nodes, links = layers[-1]
    entries = descend(small, layers[:-1], wanted, nodes)
    found, _ = beam(small, links, wanted, entries, min(max(width, n), len(nodes)))
    value = np.where(found >= 0, np.einsum("qed,qd->qe", points[found], targets), -np.inf)
    order = np.argsort(-value, axis=1, kind="stable")[:, :n]
    return np.take_along_axis(found, order, 1), np.take_along_axis(value, order, 1)


# --- tables ------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that have an id and a direction."""
    numbers = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return numbers.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _bytes(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def write_graphs(vectors: DataFrame, k: int, shard_numbers: int = SHARD_NUMBERS) -> DataFrame:
    """The index over ``vectors``: a row per shard with its vectors, their smallest k + 1 ids, and the graph in flat arrays.

    One shard has about ``shard_numbers`` components, whatever the table's size; the number of shards follows the table alone.
    """
    spark = vectors.sparkSession
    order = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ranked = usable(vectors).distinct().withColumn("n", order).where(F.col("n") <= k + 1)
    nodes = written(ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "small-world-nodes")
    sizes = nodes.groupBy(F.size("embedding").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    shards = sizes.select("dims", F.ceil(F.col("n") * F.col("dims") / shard_numbers).alias("shards"))
    tasks = shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]  # building takes long for its size: a task for each shard
    dealt = nodes.withColumn("dims", F.size("embedding")).join(shards, "dims").withColumn(
        "shard", F.pmod(F.xxhash64("embedding"), F.col("shards"))).repartition(tasks, "dims", "shard")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        points = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        ids = table["ids"].to_pylist()
        by_id = sorted(range(len(ids)), key=lambda i: (ids[i], points[i].tobytes()))
        points, ids = points[by_id], [ids[i] for i in by_id]
        layers = build_graph(points)
        return pa.table({
            "dims": pa.array([dims], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()),
            "points": _bytes([points]), "id_counts": _bytes([np.array([len(i) for i in ids], np.int32)]),
            "ids": _bytes([np.array([x for i in ids for x in i], np.int64)]),
            "layer_sizes": _bytes([np.array([len(n) for n, _ in layers], np.int64)]),
            "layer_nodes": _bytes([np.concatenate([n for n, _ in layers]).astype(np.int32)]),
            "neighbours": _bytes([np.concatenate([links.ravel() for _, links in layers]).astype(np.int32)]),
        })

    schema = ("dims int, shard bigint, points binary, id_counts binary, ids binary, layer_sizes binary, layer_nodes binary, "
              "neighbours binary")
    limit_batches(spark)
    graphs = dealt.select("dims", "shard", "embedding", "ids").groupBy("dims", "shard").applyInArrow(build, schema)
    return written(graphs, "small-world-graphs")


class _Shard:
    """A stored graph, read back."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.points = read("points", np.float64).reshape(-1, row["dims"])
        self.ids = np.split(read("ids", np.int64), np.cumsum(read("id_counts", np.int32))[:-1])
        sizes = read("layer_sizes", np.int64)
        nodes, links = read("layer_nodes", np.int32).astype(np.int64), read("neighbours", np.int32).astype(np.int64)
        self.layers = []
        for i, size in enumerate(sizes):
            most = LINKS * (2 if i == len(sizes) - 1 else 1)
            self.layers.append((nodes[:size], links[:size * most].reshape(size, most)))
            nodes, links = nodes[size:], links[size * most:]

    def nearest(self, asked: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(place of the query, vec_id, cosine), at most k per query and never its own id."""
        for start in range(0, len(asked), ROWS_AT_ONCE):
            found, value = search_graph(self.points, self.layers, asked[start:start + ROWS_AT_ONCE], k + 1)
            for q in range(len(found)):
                met = [(-v, i) for node, v in zip(found[q], value[q], strict=True) if node >= 0 for i in self.ids[node].tolist()
                       if i != own[start + q]]
                for negative, i in sorted(met)[:k]:
                    yield start + q, i, -float(negative)


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest ids of other rows, nearest first, ties to the smaller id.

    Queries travel in blocks of about QUERY_NUMBERS components, each joined to the shards of its dimension by shard number; only
    k rows per query and shard come back.
    """
    spark = graphs.sparkSession
    asked = usable(queries).distinct().withColumn("dims", F.size("embedding"))
    sizes = asked.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) * F.col("dims") / QUERY_NUMBERS).alias("blocks"))
    blocks = asked.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks"))).groupBy(
        "dims", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("queries"))
    blocks = written(blocks, "small-world-queries")
    numbers = graphs.select("dims", "shard")
    units = blocks.join(numbers, "dims").join(graphs, ["dims", "shard"])
    limit_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["dims"], row["shard"]) != last:
                    last, shard = (row["dims"], row["shard"]), _Shard(row)
                own = np.array([q["vec_id"] for q in row["queries"]], np.int64)
                vectors = np.array([q["embedding"] for q in row["queries"]], np.float64)
                found = list(shard.nearest(vectors, own, k))
                yield pa.RecordBatch.from_arrays([
                    pa.array([own[q] for q, _, _ in found], pa.int64()), pa.array([vectors[q].tobytes() for q, _, _ in found], pa.binary()),
                    pa.array([i for _, i, _ in found], pa.int64()), pa.array([v for _, _, v in found], pa.float64()),
                ], names=["query_id", "query", "vec_id", "score"])

    found = units.mapInArrow(run, "query_id bigint, query binary, vec_id bigint, score double")
    best = found.groupBy("query_id", "query", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_numbers: int = SHARD_NUMBERS) -> DataFrame:
    """Index over ``vectors`` (vec_id, embedding), searched with every row of ``queries`` (same columns).

    Defined cases: rows without vec_id, and vectors that are null, empty, all zero or hold a null or non-finite component, take no part, as
    queries and as candidates; a query meets only vectors of its own length; candidates with the query's own vec_id are the query's
    own row; rows that repeat an id and its vector count once; an id with several vectors is a candidate by its nearest, and each vector of a
    repeated query id is ranked on its own; other columns are ignored; empty tables give no rows.
    """
    return search_graphs(write_graphs(vectors, k, shard_numbers), queries, k)
