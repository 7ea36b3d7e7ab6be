"""Vector search over cells: a coarse quantiser deals vectors to cells, a query probes the cells nearest to it.

Vectors lie packed, some thousand of a cell in one row, in folders by cell. A query becomes one row per probed cell, queries of a cell
travel in blocks, and an equi-join on the cell brings both together. Where all cells are probed, which is exact, cells don't matter: packed
rows are dealt to shares, queries to blocks, and each share meets each block once. Python only multiplies the two matrices
and keeps each block's best; Spark ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmart.functions.vectors import hyperplanes, sign_codes
from parcelmart.scratch import stored

SAMPLE_NUMBERS = 4_000_000  # components of the vectors that the quantiser is trained on
ROUNDS = 8
MAX_CELLS = 4096
PACK_NUMBERS = 1 << 20  # components in one packed row
QUERY_NUMBERS = 1 << 17  # components in one block of queries
SHARE_NUMBERS = 1 << 23  # components in one share of the packed rows, about
BLOCK_NUMBERS = 1 << 21  # components in one block of queries that meets a whole share, about
SCORE_NUMBERS = 1 << 22  # scores at once
GROUP = 16  # scores of which the best is looked at first
NO_DIRECTION = -1  # cell of all-zero vectors
MAX_CODE_BITS = 12  # 4,096 folders at most


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and which rows have a direction."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    return np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0), norm > 0


# --- the quantiser ---------------------------------------------------------------------------------------


def train_centroids(vectors: DataFrame, key: str, vector: str, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means on a sample: the vectors whose key hashes lowest, SAMPLE_NUMBERS components at most.

    About the square root of the table's size, MAX_CELLS at most, unless ``cells`` is given.
    """
    known = vectors.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    size, dims = known.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not size:
        return np.zeros((0, 0))
    sample = known.select(vector, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(max(1, SAMPLE_NUMBERS // dims))
    points, _ = unit(_matrix(sample.select(vector).toArrow().column(0).combine_chunks()))
    count = min(cells or max(1, round(size ** 0.5)), MAX_CELLS, len(points))
    centroids = points[np.random.default_rng(seed).choice(len(points), count, replace=False)]
    for _ in range(ROUNDS):
        near = (points @ centroids.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        held, start = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(points[order], start, axis=0)
        centroids[held] = unit(sums)[0]
    return centroids


def _with_cells(df: DataFrame, key: str, vector: str, choose) -> DataFrame:
    """(key, vector, cell): one row per cell that ``choose`` gives for a matrix of unit vectors; NO_DIRECTION for zero vectors."""
    kind = "array<float>" if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>"  # floats move as floats
    source = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast(kind).alias("vector"))
    schema = T.StructType([*source.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            directions, known = unit(_matrix(batch.column("vector")))
            cells = choose(directions)
            cells = np.where(known[:, None], cells, np.where(np.arange(cells.shape[1]) == 0, NO_DIRECTION, NO_DIRECTION - 1))
            row, place = np.nonzero(cells >= NO_DIRECTION)
            found = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(cells[row, place], pa.int32())], names=schema.names)

    return source.mapInArrow(run, schema)


def nearest_cells(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """(key, vector, cell) for the ``probes`` cells whose centroids are nearest."""
    def choose(directions: np.ndarray) -> np.ndarray:
        n = min(probes, len(centroids))
        return np.argpartition(-(directions @ centroids.T), n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(
            np.arange(n), (len(directions), 1))

    return _with_cells(df, key, vector, choose)


# --- packed cells -----------------------------------------------------------------------------------------


def write_cells(coded: DataFrame, folder: str) -> DataFrame:
    """(key, vector, cell) rows packed and written in folders by cell. A crowded cell is split over tasks and rows."""
    spark = coded.sparkSession
    ordered = coded.hint("rebalance", "cell").sortWithinPartitions("cell", "key")
    key_type = coded.schema["key"].dataType
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("keys", T.ArrayType(key_type)),
                           T.StructField("width", T.IntegerType()), T.StructField("matrix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        cell, keys, rows = None, [], []

        def packed() -> pa.RecordBatch:
            matrix = np.concatenate(rows)
            if (matrix == (narrow := matrix.astype(np.float32))).all():  # floats stay floats
                matrix = narrow
            return pa.RecordBatch.from_arrays([
                pa.array([cell], pa.int32()), pa.array([keys], kind.field("keys").type), pa.array([matrix.itemsize], pa.int32()),
                pa.array([matrix.tobytes()], pa.binary())], schema=kind)

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for first, last in zip(*_runs(cells), strict=True):
                matrix = _matrix(batch.column("vector").slice(first, last - first))
                names = batch.column("key").slice(first, last - first).to_pylist()
                most = max(1, PACK_NUMBERS // max(1, matrix.shape[1]))
                for at in range(0, len(names), most):
                    if keys and (cell != cells[first] or len(keys) + len(names[at:at + most]) > most):
                        yield packed()
                        keys, rows = [], []
                    cell = int(cells[first])
                    keys = keys + names[at:at + most]
                    rows.append(matrix[at:at + most])
        if keys:
            yield packed()

    ordered.mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(folder)
    return read_cells(spark, folder, schema)


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)).tolist()
    return starts, [*starts[1:], len(values)]


def read_cells(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def search_cells(packed: DataFrame, probed: DataFrame, n: int, key: str, query_key: str = "query_id") -> DataFrame:
    """Nearest ``n`` keys per query in the cells it probes: (query_key, key, vector_score, vector_rank).

    ``probed`` has (key: the query's, vector, cell). Ties go to the smaller key. All-zero vectors come last, without a score, whichever cells are
    probed. The probed cells, MAX_CELLS numbers at most, become a partition filter.
    """
    wanted = stored(probed.where(F.col("cell") > NO_DIRECTION), "probed-cells")
    cells = [r["cell"] for r in wanted.select("cell").distinct().collect()]
    queries = wanted.select("key", "vector").distinct()
    size, dims = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    blocks = max(1, -(-size * dims // QUERY_NUMBERS))
    everywhere = queries.withColumn("cell", F.lit(NO_DIRECTION))
    grouped = wanted.unionByName(everywhere).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("cell", "block").agg(
        F.collect_list(F.struct(F.col("key").alias("asked"), "vector")).alias("queries"))
    # Merged, not broadcast: the written queries look small, as each is repeated for every cell, and are a matrix per cell here.
    met = packed.where(F.col("cell").isin([*cells, NO_DIRECTION])).join(grouped.hint("merge"), "cell")
    schema = T.StructType([T.StructField(query_key, probed.schema["key"].dataType),
                           T.StructField(key, packed.schema["keys"].dataType.elementType), T.StructField("vector_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values
                kept = np.frombuffer(batch.column("matrix")[i].as_py(), f"f{batch.column('width')[i].as_py()}")
                vectors, known = unit(kept.reshape(len(keys), -1).astype(np.float64))
                asked = batch.column("queries")[i].values
                targets, _ = unit(_matrix(asked.field("vector")))
                scores = np.round(targets @ vectors.T, 8) + 0.0
                scores[:, ~known] = -2.0
                query, row = _best(scores, n, _places(keys))
                found = scores[query, row]
                yield pa.RecordBatch.from_arrays([
                    asked.field("asked").take(pa.array(query)).cast(kind.field(0).type), keys.take(pa.array(row)).cast(kind.field(1).type),
                    pa.array(found, mask=found == -2.0)], schema=kind)

    return _ranked(met.select("keys", "width", "matrix", "queries").mapInArrow(run, schema), n, key, query_key)


def search_all(packed: DataFrame, queries: DataFrame, n: int, key: str, vector: str, query_key: str = "query_id") -> DataFrame:
    """Nearest ``n`` keys per query in all cells, as ``search_cells`` gives them.

    Queries are not repeated per cell. Shares and blocks have a bounded size, so a vector moves once per block and a query once per share.
    """
    directed = _with_cells(queries, query_key, vector, lambda directions: np.zeros((len(directions), 1), np.int32))
    asked = stored(directed.where(F.col("cell") > NO_DIRECTION).select("key", "vector").distinct(), "asked-vectors")
    size, dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    kept = packed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    blocks, shares = max(1, -(-size * dims // BLOCK_NUMBERS)), max(1, -(-kept * dims // SHARE_NUMBERS))

    def dealt(df: DataFrame, by: str, name: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(count)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(packed.select("keys", "width", "matrix"), "keys", "share", shares, "block", blocks)
    right = dealt(asked, "key", "block", blocks, "share", shares)
    schema = T.StructType([T.StructField(query_key, asked.schema["key"].dataType),
                           T.StructField(key, packed.schema["keys"].dataType.elementType), T.StructField("vector_score", T.DoubleType())])

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        if not rows.num_rows or not wanted.num_rows:
            return kind.empty_table()
        parts = [unit(np.frombuffer(m.as_py(), f"f{w.as_py()}").reshape(len(k.values), -1).astype(np.float64))
                 for k, w, m in zip(rows["keys"], rows["width"], rows["matrix"], strict=True)]
        vectors, known = (np.concatenate(p) for p in zip(*parts, strict=True))
        keys = pa.concat_arrays([k.values for k in rows["keys"]])
        asked, matrix = wanted["key"].combine_chunks(), unit(_matrix(wanted["vector"].combine_chunks()))[0]
        place, found = _places(keys), []
        step, rough = max(1, SCORE_NUMBERS // len(keys)), vectors.astype(np.float32)
        for at in range(0, len(matrix), step):
            query, row, best = _exact_best(matrix[at:at + step], vectors, rough, known, n, place)
            found.append(pa.Table.from_arrays([
                asked.take(pa.array(query + at)).cast(kind.field(0).type), keys.take(pa.array(row)).cast(kind.field(1).type),
                pa.array(best, mask=best == -2.0)], schema=kind))
        return pa.concat_tables(found)

    found = left.groupBy("share", "block").cogroup(right.groupBy("share", "block")).applyInArrow(run, schema)
    return _ranked(found, n, key, query_key)


def _ranked(found: DataFrame, n: int, key: str, query_key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc_nulls_last("vector_score"), F.asc(key)))
    return found.withColumn("vector_rank", rank).where(F.col("vector_rank") <= n)


def _places(keys: pa.Array) -> np.ndarray:
    """Place of each key in their order."""
    place = np.empty(len(keys), np.int64)
    place[np.argsort(np.array(keys.to_pylist(), dtype=object), kind="stable")] = np.arange(len(keys))
    return place


def _exact_best(
    queries: np.ndarray, vectors: np.ndarray, single: np.ndarray, known: np.ndarray, n: int, place: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the n best rows per query by the product of unit rows, -2 for rows that are not ``known``.

    Products of ``single`` floats leave few rows to be multiplied in full: none can be among the best that lies further below their n-th best
    than two such products err, each by less than half of ``slack``.
    """
    rough = queries.astype(np.float32) @ single.T
    rough[:, ~known] = -2.0
    slack = (queries.shape[1] + 8) * 2.0 ** -22 + 1e-7
    query, row = np.nonzero(rough >= (_floor(rough, n) - slack)[:, None])
    score = np.empty(len(query))
    part = max(1, SCORE_NUMBERS // max(1, queries.shape[1]))
    for at in range(0, len(query), part):
        cut = slice(at, at + part)
        score[cut] = np.round(np.einsum("ij,ij->i", queries[query[cut]], vectors[row[cut]]), 8) + 0.0
    score[~known[row]] = -2.0
    order = np.lexsort((place[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < n
    return query[keep], row[keep], score[keep]


def _floor(scores: np.ndarray, n: int) -> np.ndarray:
    """For each row a number that at least n of its entries reach: the n-th best of the maxima of GROUP entries each."""
    size = scores.shape[1]
    if size <= n:
        return np.full(len(scores), -np.inf)
    groups = max(size // GROUP, min(n, size))
    tops = scores[:, :groups].copy()
    for first in range(groups, size, groups):
        last = min(first + groups, size)
        np.maximum(tops[:, :last - first], scores[:, first:last], out=tops[:, :last - first])
    return np.partition(tops, groups - n, axis=1)[:, groups - n]


def _best(scores: np.ndarray, n: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the n best rows per query, ties to the smaller place."""
    if scores.shape[1] > n:
        edge = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        query, row = np.nonzero(scores >= edge[:, None])
    else:
        query, row = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((place[row], -scores[query, row], query))
    query, row = query[order], row[order]
    first = np.searchsorted(query, np.arange(len(scores)))
    keep = np.arange(len(query)) - first[query] < n
    return query[keep], row[keep]


# --- cells by sign code -------------------------------------------------------------------------------------


def code_cells(df: DataFrame, key: str, vector: str, dimensions: int, bits: int, seed: int = 7, radius: int = 0) -> DataFrame:
    """(key, vector, cell): the cell is a vector's sign code, or every code within ``radius`` bits of it."""
    if not 1 <= bits <= MAX_CODE_BITS:
        raise ValueError(f"bits must be from 1 to {MAX_CODE_BITS}")
    planes = hyperplanes(dimensions, bits, seed)
    near = np.array([x for x in range(1 << bits) if x.bit_count() <= radius])
    return _with_cells(df, key, vector, lambda directions: sign_codes(directions, planes)[:, None] ^ near[None, :])


