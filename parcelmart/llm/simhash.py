"""SimHash near-duplicates by a byte-position index with count filtering.

A fingerprint is 8 bytes at 8 positions. Two fingerprints that differ in at most 4 bits agree in at least 4 of
the 8 positional bytes. The index has one list for each set of three positions (out of 20 sets such that any 4 positions
hold one of them) and the bytes there, so every such pair meets in some list. Within a list the shared
positional bytes of each pair are tallied, pairs below 4 are dropped, and the rest is verified on all bits.

Only distinct fingerprints are indexed: exact copies meet in one row before. A list gives the links of a spanning forest
of its verified pairs, never all pairs, and a list longer than LIST_ROWS is dealt to tasks as pairs of blocks, so that
no task holds more than two blocks and no link is lost.

Null and empty texts have fingerprint zero and are linked like any other. Rows with equal doc_id or text
are rows of their own. A null doc_id belongs to its component, but never names it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.components import components
from parcelmart.llm.texts import per_text, written

#: Differing bits up to which fingerprints are linked, and the positional bytes such a pair must share.
MAX_BITS, MIN_SHARED = 4, 4
LIST_ROWS = 8192


def position_sets(sizes: tuple[int, int, int] = (3, 3, 2)) -> list[tuple[int, int, int]]:
    """Sets of three of the eight positions such that any four positions hold one of the sets.

    The positions are parted in three classes in a ring; a set lies in one class, or has two in a class and one in
    the next. (Of any four positions, either three are in one class, or two are in one and the next holds another.)
    """
    kind = [c for c, n in enumerate(sizes) for _ in range(n)]
    sets = []
    for s in combinations(range(len(kind)), 3):
        n = [sum(kind[p] == c for p in s) for c in range(3)]
        if 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3)):
            sets.append(s)
    return sets


def fingerprint(text: bytes, width: int = 4) -> int:
    """Unsigned fingerprint: a bit is set if it is in over half the hashes of all word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - width + 1, 1)
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (one(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[len(words) - n:].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        part = hashes[low:low + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``fp`` (the fingerprint's bits as a signed long) of every text."""

    def make():
        def run(texts: list[bytes]) -> list:
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            return [pa.array(found.view(np.int64))]

        return run

    return per_text(docs, make, "fp long", keep)


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest over the linked pairs of distinct fingerprints (unsigned)."""
    rows = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    left, links = np.arange(len(values)), []
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            shared = (rows[left] == rows[at]).sum(axis=1) >= MIN_SHARED
            near = left[shared]
            near = near[np.bitwise_count(values[near] ^ values[at]) <= MAX_BITS]
            if near.size:
                links += [(int(values[at]), int(values[x])) for x in near]
                queue += near.tolist()
                left = left[~np.isin(left, near)]
    return links


def list_links(lists: DataFrame) -> DataFrame:
    """(a, b) links with a < b, from rows (list, part, fp): each group of (list, part) is streamed through one task."""

    def links(values: list[np.ndarray]) -> list[tuple[int, int]]:
        return forest(np.unique(np.concatenate(values).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []

        def batch() -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

        for rows in batches:
            if not rows.num_rows:
                continue
            key = [c.to_numpy() for c in rows.columns[:2]]
            fp = rows.column(2).to_numpy()
            cuts = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                group = (key[0][low], key[1][low])
                if group != now:
                    if held:
                        found += links(held)
                    now, held = group, []
                held.append(fp[low:high])
            if len(found) > 50_000:
                yield batch()
                found = []
        if held:
            found += links(held)
        if found:
            yield batch()

    grouped = lists.repartition("list", "part").sortWithinPartitions("list", "part")
    return grouped.mapInArrow(run, "a long, b long")


def _list_key(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    """Number of the position set and the bytes there, in one long."""
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)))
    return key


def near_pairs(distinct: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links (a < b) that join the same fingerprints of ``distinct`` (column fp) as all verified pairs do."""
    keys = F.array(*[_list_key(F.col("fp"), i, s) for i, s in enumerate(position_sets())])
    lists = distinct.select("fp", F.explode(keys).alias("list"))
    longer = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = lists.join(longer, "list").withColumn("blocks", F.ceil(F.col("n") / list_rows))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # a block meets every block (itself included) under the key of the two
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
    return list_links(dealt.select("list", F.explode(parts).alias("part"), "fp")).distinct()


def _members(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``keep`` columns and fp; fp, its smallest doc_id ``first`` and its component ``root``. Both are written."""
    rows = written(fingerprints(docs, keep), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reached = components(near_pairs(distinct.select("fp")))
    return rows, written(distinct.join(reached.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "members")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (doc_id among them), fp and component_id, the smallest doc_id that can be reached by links."""
    rows, members = _members(docs, keep)
    named = written(members.groupBy("root").agg(F.min("first").alias("component_id")), "component-names")
    # joins of plain scans, which can be split at a very large component or a very common fingerprint
    by_fingerprint = written(members.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(by_fingerprint, "fp")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Documents, with all their columns, of which one per component of linked texts stays.

    It is one with the component's smallest doc_id; of several with that doc_id the one with the least hash of its text,
    of equal rows any. Rows of one doc_id with texts that are not linked belong to different components, so each
    component keeps its own. Rows without doc_id are not compared and stay.
    """
    names = ["text_hash", "text_group"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    hashed_name, group = names
    key = ["doc_id", hashed_name]
    hashed = docs.withColumn(hashed_name, F.xxhash64("text"))
    rows, members = _members(hashed.where("doc_id is not null"), tuple(key))
    found = rows.join(members.select("fp", F.col("root").alias(group)), "fp")
    first = found.groupBy(group).agg(F.min(F.struct(*key)).alias("first")).select("first.*")
    kept = hashed.join(first, key, "left_semi").dropDuplicates(key)
    return kept.unionByName(hashed.where("doc_id is null")).select(*[f"`{c}`" for c in docs.columns])
