"""Ranked lexical search with an index of posting lists in geometric blocks.

Documents are held in shards. In a shard the posting list of each asked term is clustered by the likeness of its documents, and each
cluster, a block, stores the coordinatewise maximum of its documents' vectors. A query walks its terms from the
rarest to the most frequent. A block's summary times the query bounds the score of any document in it that has not been met: of
terms walked before, such a document has none, or it was in a block whose bound was too low. So only the coordinates of
the terms from the list's own on count, long lists need short summaries, and a block is skipped only where its bound
is below the score of the last place so far; all other blocks are scored in full. Results are exact.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmart.llm.texts import limit_batches, per_text, written

#: On UTF-8 bytes after ASCII lower-casing: digits, letters and every character beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
K = 20
ITEM_BYTES = 1 << 18  # of item texts that are searched in one pass
SHARD_CELLS = 1 << 24  # documents of a shard times asked terms
SHARD_DOCUMENTS = 4096
BLOCK_DOCUMENTS = 64
SKETCH = 32  # numbers that stand for a document when lists are clustered
SEED = 29


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


# --- items -----------------------------------------------------------------------------------------------


@dataclass
class Items:
    """A block of items. Terms are numbered from the rarest to the most frequent once weights are known."""

    ids: list
    counts: list[Counter]
    terms: list[bytes] = field(default_factory=list)
    weights: np.ndarray | None = None

    def vocabulary(self) -> list[bytes]:
        return sorted({term for counts in self.counts for term in counts})

    def ordered(self, terms: list[bytes], weights: np.ndarray) -> "Items":
        order = sorted(range(len(terms)), key=lambda i: (-weights[i], terms[i]))
        return Items(self.ids, self.counts, [terms[i] for i in order], weights[order])

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weight times occurrences) per item, rarest first; terms without weight are left out."""
        number = {term: i for i, term in enumerate(self.terms)}
        out = []
        for counts in self.counts:
            some = np.array(sorted(number[t] for t in counts), np.int64)
            times = np.array([counts[self.terms[i]] for i in some], np.int64)
            value = times * self.weights[some] if len(some) else times
            out.append((some[value > 0], value[value > 0]))
        return out

    def coordinates(self) -> list[np.ndarray]:
        """Per term the terms, itself and later ones, that an item asks together with it: what its summaries hold."""
        together: list[list[np.ndarray]] = [[] for _ in self.terms]
        for some, _ in self.vectors():
            for j, term in enumerate(some):
                together[term].append(some[j:])
        return [np.unique(np.concatenate(t)) if t else np.zeros(0, np.int64) for t in together]


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """Items in blocks of about ``limit`` bytes of text, dealt by hash; a repeated row is one item."""
    rows = written(items.select("item_id", "text").distinct(), "search-items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        found = part.collect()
        yield Items([r["item_id"] for r in found], [Counter(terms_of((r["text"] or "").encode())) for r in found])


# --- one shard -------------------------------------------------------------------------------------------


@dataclass
class Shard:
    """``sizes[t]`` postings and ``blocks[t]`` blocks of term t; ``listed`` are documents by term and block."""

    ids: np.ndarray
    named: np.ndarray
    rows: np.ndarray  # number of terms of each document
    terms: np.ndarray
    parts: np.ndarray  # what one occurrence weight is multiplied by, by document and term
    listed: np.ndarray
    blocks: np.ndarray  # per term
    block_sizes: np.ndarray
    maxima: np.ndarray  # per term and block, one number for each of the term's coordinates

    FIELDS = (("ids", np.int64), ("named", np.bool_), ("rows", np.int32), ("terms", np.int32), ("parts", np.int32), ("listed", np.int32),
              ("blocks", np.int32), ("block_sizes", np.int32), ("maxima", np.int32))

    def dense(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.ids), width), np.int32)
        out[np.repeat(np.arange(len(self.ids)), self.rows), self.terms] = self.parts
        return out


def build_shard(ids, named, rows, terms, parts, weights: np.ndarray, coordinates: list[np.ndarray]) -> Shard:
    """Lists in blocks of about BLOCK_DOCUMENTS documents that are alike, with their maxima."""
    shard = Shard(ids, named, rows, terms, parts, *[np.zeros(0, np.int32)] * 4)
    dense = shard.dense(len(weights))
    signs = np.random.default_rng(SEED).choice(np.float32([-1, 1]), (len(weights), SKETCH))
    sketch = np.concatenate([(dense[i:i + 256] * weights.astype(np.float32)) @ signs for i in range(0, len(ids), 256)])
    sketch /= np.maximum(np.sqrt((sketch * sketch).sum(axis=1, keepdims=True)), 1e-9)
    order = np.argsort(terms, kind="stable")
    listed = np.repeat(np.arange(len(ids)), rows)[order]
    end = np.searchsorted(terms[order], np.arange(len(weights)), side="right")
    out, blocks, sizes, maxima, begin = [], [], [], [], 0
    for term, stop in enumerate(end):
        some, begin, wide = listed[begin:stop], stop, coordinates[term]
        if not len(some) or not len(wide):
            blocks.append(0)
            continue
        count = -(-len(some) // BLOCK_DOCUMENTS)
        cuts = np.array([0])
        if count > 1:
            pivots = some[np.linspace(0, len(some) - 1, count).astype(np.int64)]
            near = (sketch[some] @ sketch[pivots].T).argmax(axis=1)
            by_block = np.argsort(near, kind="stable")
            some, near = some[by_block], near[by_block]
            cuts = np.flatnonzero(np.diff(near, prepend=-1))
        out.append(some)
        blocks.append(len(cuts))
        sizes.append(np.diff(cuts, append=len(some)))
        maxima.append(np.maximum.reduceat(dense[some[:, None], wide[None, :]], cuts, axis=0).ravel())
    joined = lambda arrays: np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    shard.listed, shard.blocks, shard.block_sizes, shard.maxima = joined(out), np.array(blocks, np.int32), joined(sizes), joined(maxima)
    return shard


class Search:
    """The best documents per item over the shards seen so far."""

    def __init__(self, items: Items, k: int) -> None:
        self.k, self.width = k, len(items.terms)
        self.vectors, self.coordinates = items.vectors(), items.coordinates()
        self.columns = [[np.searchsorted(self.coordinates[t], some[j:]) for j, t in enumerate(some)] for some, _ in self.vectors]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in self.vectors]
        self.scored = self.skipped = 0

    def _keep(self, item: int, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        held = [np.concatenate(pair) for pair in zip(self.best[item], (scores, ids, named), strict=True)]
        if len(held[0]) > 4 * self.k:
            floor = np.partition(held[0], len(held[0]) - self.k)[len(held[0]) - self.k]
            held = [h[held[0] >= floor] for h in held]
        order = np.lexsort((held[1], ~held[2], -held[0]))[:self.k]
        self.best[item] = tuple(h[order] for h in held)

    def add(self, shard: Shard) -> None:
        dense = shard.dense(self.width)
        block_end = np.cumsum(shard.blocks)
        list_end = np.cumsum(shard.block_sizes)
        wide = shard.blocks.astype(np.int64) * np.array([len(c) for c in self.coordinates], np.int64)
        maxima_end = np.cumsum(wide)
        met = np.full(len(shard.ids), -1, np.int64)
        for item, (some, weights) in enumerate(self.vectors):
            for j, term in enumerate(some):
                count = shard.blocks[term]
                if not count:
                    continue
                first = block_end[term] - count
                maxima = shard.maxima[maxima_end[term] - wide[term]:maxima_end[term]].reshape(count, -1)
                bounds = maxima[:, self.columns[item][j]].astype(np.int64) @ weights[j:]
                scores = self.best[item][0]
                going = bounds >= scores[-1] if len(scores) == self.k else bounds > 0
                self.skipped += count - int(going.sum())
                if not going.any():
                    continue
                blocks = first + np.flatnonzero(going)
                if len(blocks) == count:
                    begin = list_end[first] - shard.block_sizes[first]
                    documents = shard.listed[begin:list_end[first + count - 1]]
                else:
                    documents = np.concatenate([shard.listed[list_end[b] - shard.block_sizes[b]:list_end[b]] for b in blocks])
                documents = documents[met[documents] != item]
                if not len(documents):
                    continue
                met[documents] = item
                self.scored += len(documents)
                value = dense[documents[:, None], some[None, :]].astype(np.int64) @ weights
                if len(scores) == self.k:
                    documents, value = documents[value >= scores[-1]], value[value >= scores[-1]]
                documents, value = documents[value > 0], value[value > 0]
                if len(documents):
                    self._keep(item, value, shard.ids[documents], shard.named[documents])


# --- tables ------------------------------------------------------------------------------------------------


def counted_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document, from its whole text: n, all its terms with repeats; and the asked ones with their occurrences."""
    number = {term: i for i, term in enumerate(vocabulary)}

    def make():
        def count(texts: list[bytes]) -> list:
            sizes, terms, times = [], [], []
            for text in texts:
                found = terms_of(text)
                asked = Counter(i for i in map(number.get, found) if i is not None)
                sizes.append(len(found))
                terms.append(list(asked))
                times.append(list(asked.values()))
            return [sizes, terms, times]

        return count

    return per_text(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make,
                    "n bigint, terms array<int>, times array<int>")


def _list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def document_counts(counted: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each asked term; summed in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_list_values(batch.column("terms"))[1], minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for row in counted.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def term_weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def write_shards(counted: DataFrame, items: Items, order: np.ndarray, documents: int, occurrences: int) -> DataFrame:
    """The index: one row per shard, each of neighbouring rows of ``counted``, without a shuffle.

    ``order`` are the new numbers of the terms. Flat arrays as bytes, named as in ``Shard``.
    """
    coordinates, weights = items.coordinates(), items.weights
    most = max(1, min(SHARD_DOCUMENTS, SHARD_CELLS // max(1, len(weights))))
    names = [n for n, _ in Shard.FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def shard_row() -> pa.RecordBatch:
            ids, named, rows, terms, parts = (np.concatenate(c) for c in zip(*held, strict=True))
            shard = build_shard(ids, named, rows, terms, parts, weights, coordinates)
            return pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(getattr(shard, n), k).tobytes()], pa.binary()) for n, k in Shard.FIELDS], names=names)

        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                size, term = _list_values(part.column("terms"))
                times = _list_values(part.column("times"))[1].astype(np.int64)
                length = 75 + 25 * part.column("n").to_numpy() * documents // max(1, occurrences)
                parts = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(length, size))
                ids = part.column("doc_id")
                if held and sum(len(h[0]) for h in held) + len(size) > most:
                    yield shard_row()
                    held = []
                held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), size, order[term], parts))
        if held:
            yield shard_row()

    with_terms = counted.where(F.size("terms") > 0)
    return written(with_terms.mapInArrow(run, ", ".join(f"{n} binary" for n in names)), "search-shards")


def search_shards(shards: DataFrame, items: Items, item_type: T.StructField, k: int) -> DataFrame:
    """(item_id, place, doc_id, score): each task's best documents per item, over all its shards."""
    schema = T.StructType([item_type, *T.StructType.fromDDL("place int, doc_id bigint, score bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        search = Search(items, k)
        for batch in batches:
            for i in range(batch.num_rows):
                search.add(Shard(**{n: np.frombuffer(batch.column(n)[i].as_py(), kind) for n, kind in Shard.FIELDS}))
        rows = [(items.ids[i], i, int(d) if named else None, int(s)) for i, best in enumerate(search.best)
                for s, d, named in zip(*best, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], to_arrow_type(f.dataType)) for c, f in enumerate(schema.fields)], names=schema.names)

    return shards.mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0, equal scores by doc_id.

    Defined cases: a null or empty text has no terms, so an item without any gives no rows and a document without any is not
    counted; each row of ``docs`` is a document, repeated rows too; one without doc_id counts and is listed after others of its score;
    a repeated row of ``items`` is one item, and rows that share an item_id but not the text are ranked each on its own; other columns are ignored.
    Items are searched in blocks of ITEM_BYTES of text, one pass over the documents each.
    """
    limit_batches(docs.sparkSession)
    found = None
    for n, block in enumerate(item_blocks(items)):
        vocabulary = block.vocabulary()
        counted = written(counted_terms(docs, vocabulary), "search-counts")
        documents, occurrences = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        ready = block.ordered(vocabulary, term_weights(document_counts(counted, len(vocabulary)), documents))
        number = {term: i for i, term in enumerate(ready.terms)}
        shards = write_shards(counted, ready, np.array([number[t] for t in vocabulary], np.int64), documents, occurrences)
        part = written(search_shards(shards, ready, items.schema["item_id"], k), "search-best").withColumn("block", F.lit(n))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id", "block", "place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
