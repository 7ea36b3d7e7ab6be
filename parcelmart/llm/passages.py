"""Substring dedup: repeated passages, exact or fuzzy, by collinear chaining of shared k-mer seeds.

Seeds are the least hashed of every WINDOW neighbouring k-mers of words, so any passage of K + WINDOW - 1 words or more
that two documents share exactly has a seed in common. Each place of a seed is joined to the seed's first place (the
smallest doc_id), never to all others. Per pair of documents the matches are chained in order with gap costs through a
Fenwick tree, and chains that may reach MIN_WORDS are aligned word by word from the texts on either side.

A passage is reported against one earlier document. As the seeds of a passage may first occur elsewhere, each in some other
text, each window of MIN_WORDS words is joined to the window's own first place too, so that every exact passage meets a
document that has all of it. Only windows whose seeds all occur twice or more are hashed: others stand nowhere else.
Passages with changed words are found by seeds alone; those whose every seed first occurs elsewhere can be missed.

Null and empty texts have no passages; rows without doc_id are not compared. Rows with equal doc_id and text count as
one document, rows with equal doc_id and other text as another. Repeats within one document are not reported.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.decontaminate import merge_spans
from parcelmart.llm.texts import limit_batches, slices, written

K, WINDOW, MIN_WORDS = 5, 16, 50
#: Least share of equal words in a passage.
IDENTITY = 0.8
GAP_COST = 0.05
#: Words around a chain that alignment may reach.
PAD = 64
#: Words of a block of text. Most texts are one block; of a longer one alignments fetch the blocks they need.
BLOCK_WORDS = 1024
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def seeds(words: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of a document's seeds."""
    if len(words) < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mixed = _mixed(h, np.arange(len(h) - K + 1), K)
    at = np.unique(_least(mixed))
    return mixed[at], at


def _mixed(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` words from the places on."""
    mixed = h[at]
    for j in range(1, length):
        mixed = mixed * _MIX + h[at + j]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    return mixed


def _least(mixed: np.ndarray) -> np.ndarray:
    """The place of the least hash of every WINDOW neighbours."""
    n = len(mixed)
    if n <= WINDOW:
        return np.array([int(mixed.argmin())])
    return np.lib.stride_tricks.sliding_window_view(mixed, WINDOW).argmin(axis=1) + np.arange(n - WINDOW + 1)


def windows(words: list[bytes], repeating: np.ndarray, hashes: Hashes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the windows of ``length`` words whose seeds are all among the places ``repeating``."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    at, inner = np.arange(n), length - K - WINDOW + 2
    if inner > 0:  # seeds of a window: the least of each WINDOW k-mers that lie in it
        single = np.concatenate(([0], np.cumsum(~np.isin(_least(_mixed(h, np.arange(len(h) - K + 1), K)), repeating))))
        at = np.flatnonzero(single[inner:] == single[:-inner])
    return _mixed(h, at, length), at


def chains(q: list[int], r: list[int]) -> list[list[int]]:
    """Chains of matches (numbers into q, r; q ascending): ordered in both texts, best score first, none used twice.

    A match is worth K words; a step from one to the next costs GAP_COST for each word passed in either text. The best
    predecessor with smaller r comes from a Fenwick tree of prefix maxima.
    """
    n = len(q)
    if all(0 < b - a <= K / (2 * GAP_COST) for a, b in zip(q, q[1:])) and len({a - b for a, b in zip(q, r, strict=True)}) == 1:
        return [list(range(n))]  # all on one diagonal without a gap that costs more than a match
    place = {v: i + 1 for i, v in enumerate(sorted(set(r)))}
    tree, tree_at = [0.0] * (len(place) + 1), [-1] * (len(place) + 1)
    score, back = [0.0] * n, [-1] * n
    for i in range(n):
        at, best, before = place[r[i]] - 1, 0.0, -1
        while at > 0:
            if tree_at[at] >= 0 and (before < 0 or tree[at] > best):
                best, before = tree[at], tree_at[at]
            at &= at - 1
        here = GAP_COST * (q[i] + r[i])
        score[i] = float(K)
        if before >= 0 and best - here > 0:
            score[i], back[i] = K + best - here, before
        at, value = place[r[i]], score[i] + here
        while at <= len(place):
            if tree_at[at] < 0 or value > tree[at]:
                tree[at], tree_at[at] = value, i
            at += at & -at
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def may_be_long(q: np.ndarray) -> np.ndarray:
    """Which matches (ascending first words) lie in a run of matches, to any document, that may belong to a long passage.

    An exact passage has a seed in each WINDOW k-mers, one with changed words may lack some; a run bears gaps of two windows.
    """
    run = np.concatenate(([0], np.cumsum(np.diff(q) > 2 * (WINDOW + K))))
    first = np.searchsorted(run, np.arange(run[-1] + 1))
    last = np.searchsorted(run, np.arange(run[-1] + 1), "right") - 1
    return (q[last] + K - q[first] >= MIN_WORDS - 2 * (WINDOW - 1))[run]


#: Steps (in q, in r) over words that differ; the shortest first.
_STEPS = sorted(((a, b) for a in range(5) for b in range(5) if a or b), key=lambda s: (s[0] + s[1], abs(s[0] - s[1])))
_AGREE = 3


def _extend(q: list, r: list, i: int, j: int, i_end: int, j_end: int, step: int) -> list[tuple[int, int, int]]:
    """Blocks (first q, first r, length) of equal words from (i, j) on in direction ``step``, over small differences.

    Stops at the ends, or where no small step leads to ``_AGREE`` equal words.
    """
    blocks = []
    while True:
        n = 0
        while i != i_end and j != j_end and q[i] == r[j]:
            i, j, n = i + step, j + step, n + 1
        if n:
            blocks.append((i - n, j - n, n) if step > 0 else (i + 1, j + 1, n))
        for a, b in _STEPS:
            x, y = i + a * step, j + b * step
            rest = min((i_end - x) * step, (j_end - y) * step)
            if rest >= _AGREE and all(q[x + t * step] == r[y + t * step] for t in range(_AGREE)):
                i, j = x, y
                break
        else:
            return blocks


def align(q: list, r: list, matches: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Passages (q start, q end, r start, r end, equal words) along a chain of matches within two lists of words."""
    blocks = _extend(q, r, matches[0][0] - 1, matches[0][1] - 1, -1, -1, -1)[::-1]
    at_q, at_r = matches[0]
    for i, (mq, mr) in enumerate(matches):
        if mq < at_q or mr < at_r:
            continue  # within what has been aligned
        end = matches[i + 1] if i + 1 < len(matches) and matches[i + 1][0] > mq + K and matches[i + 1][1] > mr + K else (len(q), len(r))
        found = _extend(q, r, mq, mr, max(end[0], mq + K), max(end[1], mr + K), 1)
        if not found:
            continue
        blocks += found
        at_q, at_r = found[-1][0] + found[-1][2], found[-1][1] + found[-1][2]
    out: list[list[int]] = []
    for bq, br, n in blocks:
        if out:
            first_q, end_q, first_r, end_r, equal = out[-1]
            span = max(bq + n - first_q, br + n - first_r)
            if bq >= end_q and br >= end_r and equal + n >= IDENTITY * span and bq - end_q <= PAD:
                out[-1][1], out[-1][3], out[-1][4] = bq + n, br + n, equal + n
                continue
        out.append([bq, bq + n, br, br + n, n])
    return [tuple(x) for x in out]


def _seed_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                found = [seeds(t.lower().split(), hashes) for t in texts]
                n = np.fromiter((len(s) for s, _ in found), np.int64, len(found))
                which = pa.array(np.repeat(np.arange(start, start + len(texts)), n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([s for s, _ in found]).view(np.int64)), batch.column(0).take(which),
                    batch.column(1).take(which), pa.array(np.concatenate([p for _, p in found]).astype(np.int32)),
                ], names=["seed", "doc_id", "version", "at"])

    return docs.mapInArrow(run, "seed long, doc_id long, version long, at int")


def _window_rows(docs: DataFrame, length: int) -> DataFrame:
    """Windows from doc_id, version, text and the places of repeating seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                places = [batch.column(3)[start + i].values.to_numpy() for i in range(len(texts))]
                found = [windows(t.lower().split(), p, hashes, length) for t, p in zip(texts, places, strict=True)]
                n = np.fromiter((len(s) for s, _ in found), np.int64, len(found))
                which = pa.array(np.repeat(np.arange(start, start + len(texts)), n))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([s for s, _ in found]).view(np.int64)), batch.column(0).take(which),
                    batch.column(1).take(which), pa.array(np.concatenate([p for _, p in found]).astype(np.int32)),
                ], names=["seed", "doc_id", "version", "at"])

    return docs.mapInArrow(run, "seed long, doc_id long, version long, at int")


def window_matches(table: np.ndarray, length: int) -> np.ndarray:
    """Seed matches at both ends of windows (rows at, doc, version, first_at): of a run, of each length / 2 windows one."""
    table = table[np.lexsort((table[:, 0], table[:, 3] - table[:, 0], table[:, 2], table[:, 1]))]
    same = (np.diff(table[:, [1, 2]], axis=0) == 0).all(axis=1) & (np.diff(table[:, 0]) == 1) & (np.diff(table[:, 3]) == 1)
    start = np.flatnonzero(np.concatenate(([True], ~same)))
    within = np.arange(len(table)) - np.repeat(start, np.diff(np.append(start, len(table))))
    last = np.concatenate((~same, [True]))
    kept = table[(within % max(length // 2, 1) == 0) | last]
    return np.unique(np.concatenate((kept, kept + np.array([1, 0, 0, 1]) * max(length - K, 0))), axis=0)


def _chain_rows(matches: DataFrame, min_words: int) -> DataFrame:
    """Chains per document from its list of matches (at, first_doc, first_version, first_at, whether of a window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, version, found in zip(*(batch.column(i) for i in range(3)), strict=True):
                table = np.array(
                    [found.values.field(i).to_numpy(zero_copy_only=False) for i in range(5)], np.int64).T
                of_windows, table = table[table[:, 4] == 1, :4], table[table[:, 4] == 0, :4]
                table = table[np.argsort(table[:, 0], kind="stable")]
                if len(table):
                    table = table[may_be_long(table[:, 0])]
                if len(of_windows):
                    table = np.unique(np.concatenate((table, window_matches(of_windows, min_words))), axis=0)
                if not len(table):
                    continue
                table = table[np.lexsort((table[:, 3], table[:, 0], table[:, 2], table[:, 1]))]
                cuts = np.flatnonzero((np.diff(table[:, 1]) != 0) | (np.diff(table[:, 2]) != 0)) + 1
                for part in np.split(table, cuts):
                    q, r = part[:, 0].tolist(), part[:, 3].tolist()
                    for chain in chains(q, r):
                        rows.append((doc.as_py(), version.as_py(), int(part[0, 1]), int(part[0, 2]),
                                     [q[i] for i in chain], [r[i] for i in chain]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)],
                    names=["doc_id", "version", "other_id", "other_version", "q", "r"])

    return matches.mapInArrow(run, "doc_id long, version long, other_id long, other_version long, q array<int>, r array<int>")


def _block_rows(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, version, text) as blocks of BLOCK_WORDS words, lower-cased and space-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                found = [t.lower().split() for t in texts]
                n = np.fromiter((-(-len(w) // BLOCK_WORDS) for w in found), np.int64, len(found))
                which = pa.array(np.repeat(np.arange(start, start + len(texts)), n))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(which), batch.column(1).take(which),
                    pa.array([i for c in n.tolist() for i in range(c)], pa.int32()),
                    pa.array([b" ".join(w[i:i + BLOCK_WORDS]) for w in found for i in range(0, len(w), BLOCK_WORDS)], pa.binary()),
                ], names=["doc_id", "version", "block", "words"])

    return docs.mapInArrow(run, "doc_id long, version long, block int, words binary")


def _cut_rows(asked: DataFrame) -> DataFrame:
    """The words of each row's block that lie in the asked range (low, high) of its text, and the first one's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, block = (batch.column(i).to_pylist() for i in (2, 3, 4))
            at, out, before, words = [], [], None, []
            for start, texts in slices(batch.column(5)):
                for i, text in enumerate(texts, start):
                    if text != before:
                        before, words = text, text.split()
                    first = block[i] * BLOCK_WORDS
                    at.append(max(low[i], first))
                    out.append(b" ".join(words[at[-1] - first:high[i] - first]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at, pa.int32()), pa.array(out, pa.binary())],
                                             names=["chain", "side", "low", "words"])

    return asked.mapInArrow(run, "chain long, side int, low int, words binary")


def _around(parts: list[dict]) -> tuple[int, list[bytes]]:
    """The place of the first word and all words of one side of a chain, from its parts."""
    parts = sorted(parts, key=lambda p: p["low"])
    return parts[0]["low"], [w for p in parts for w in p["words"].split()]


def _aligned_rows(pairs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*batch.columns, strict=True):
                doc, version, other, q, r, *sides = (c.as_py() for c in row)
                (q_low, q_words), (r_low, r_words) = map(_around, sides)
                matches = [(a - q_low, b - r_low) for a, b in zip(q, r, strict=True)]
                for a, b, c, d, n in align(q_words, r_words, matches):
                    if b - a >= min_words:
                        out.append((doc, version, a + q_low, b + q_low, other, c + r_low, d + r_low, n))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                    names=["doc_id", "version", "first_word", "end_word", "other_id", "other_first", "other_end", "n_equal"])

    return pairs.mapInArrow(
        run, "doc_id long, version long, first_word long, end_word long, other_id long, other_first long, other_end long, n_equal long")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of ``min_words`` or more that an earlier document has as well.

    doc_id and version (hash of the text) of the later document, its first word and the word after the last; the same of
    the earlier one; and the number of equal words.
    """
    rows = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"),
        F.col("text").cast("binary").alias("text"))
    limit_batches(docs.sparkSession)
    found = written(_seed_rows(rows), "seeds")

    def first_places(found: DataFrame, name: str) -> DataFrame:
        first = found.groupBy("seed").agg(
            F.min(F.struct("doc_id", "version", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return written(first.drop("n"), name)  # a join of two plain scans, which can be split at a hot seed

    def matched(found: DataFrame, first: DataFrame, of_window: int) -> DataFrame:
        other = F.struct("at", F.col("first.doc_id").alias("d"), F.col("first.version").alias("v"),
                         F.col("first.at").alias("a"), F.lit(of_window).alias("w"))
        matches = found.join(first, "seed").where("doc_id != first.doc_id or version != first.version")
        return matches.select("doc_id", "version", other.alias("other"))

    first = first_places(found, "first-places")
    repeating = found.join(first.select("seed"), "seed").groupBy("doc_id", "version").agg(F.collect_set("at").alias("repeating"))
    long_ones = written(_window_rows(rows.join(repeating, ["doc_id", "version"]).select(
        "doc_id", "version", "text", "repeating"), min_words), "windows")
    matches = matched(found, first, 0).unionByName(matched(long_ones, first_places(long_ones, "first-windows"), 1))
    per_doc = matches.groupBy("doc_id", "version").agg(F.collect_set("other").alias("found"))
    chained = written(_chain_rows(per_doc, min_words).withColumn("chain", F.monotonically_increasing_id()), "chains")

    def ask(side: int, doc: str, version: str, places: str) -> DataFrame:
        return chained.select(
            "chain", F.lit(side).alias("side"), F.col(doc).alias("doc_id"), F.col(version).alias("version"),
            F.greatest(F.element_at(places, 1) - PAD, F.lit(0)).alias("low"),
            (F.element_at(places, -1) + K + PAD).alias("high"))

    asked = ask(0, "doc_id", "version", "q").unionByName(ask(1, "other_id", "other_version", "r"))
    first, last = (F.floor(c / BLOCK_WORDS).cast("int") for c in (F.col("low"), F.col("high") - 1))
    asked = asked.withColumn("block", F.explode(F.sequence(first, last)))
    # a text that very many chains ask for answers each with a block; no aggregate stands below, so a hot block can be split
    texts = asked.join(_block_rows(rows), ["doc_id", "version", "block"])  # repeated rows give equal parts
    cut = _cut_rows(texts.select("chain", "side", "low", "high", "block", "words"))
    sides = cut.groupBy("chain").agg(*[
        F.collect_set(F.when(F.col("side") == s, F.struct("low", "words"))).alias(f"parts_{s}") for s in (0, 1)])
    pairs = chained.join(sides, "chain").select("doc_id", "version", "other_id", "q", "r", "parts_0", "parts_1")
    return _aligned_rows(pairs, min_words).distinct()


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, each passage left only where it stands first.

    A document that is all repeats keeps its row with what is left of its text.
    """
    extra = ["repeat_version", "repeat_spans"]
    while set(extra) & set(docs.columns):
        extra = [c + "_" for c in extra]
    spans = repeated_passages(docs, min_words).groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("first_word", "end_word")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias(extra[0] + "_id"), F.col("version").alias(extra[0]),
                         F.to_json(F.sort_array("spans")).alias(extra[1]))
    hashed = docs.withColumn(extra[0], F.xxhash64("text"))
    joined = hashed.join(
        spans, (hashed["doc_id"] == spans[extra[0] + "_id"]) & (hashed[extra[0]] == spans[extra[0]]), "left")
    joined = joined.select(*[hashed[f"`{c}`"] for c in docs.columns], spans[extra[1]])
    where, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(where), batch.column(batch.num_columns - 1)
            new = [t.as_py() if not s.is_valid else cut_words(
                t.as_py().encode(), merge_spans([(x["first_word"], x["end_word"]) for x in json.loads(s.as_py())])).decode()
                for t, s in zip(texts, found, strict=True)]
            arrays = list(batch.columns[:-1])
            arrays[where] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(run, schema)
