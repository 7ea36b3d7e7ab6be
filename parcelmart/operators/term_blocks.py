"""Lexical search of many queries at once: blocks of queries meet shares of chunks, as vectors do in ``cells.search_all``.

A query is a row of terms, a share of chunks a matrix of which chunk has which term, and the hits are their product. Each share meets each block
once. Python adds up the rows of the matrix and keeps each block's best; Spark deals both sides and ranks what is left.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmart.scratch import stored

SHARE_CHARS = 1 << 23  # characters of text in one share of the chunks, about
BLOCK_QUERIES = 32768  # queries in one block, about
STEP_SUMS = 1 << 16  # sums at once, so that they stay near the processor
TILE = 256  # chunks whose matrix is made at once
SLICE_CHARS = 1 << 19  # characters of text that terms are looked for in at once, about
LONG = 32  # first letters of a term that are hashed
BASE = np.uint64(0x9E3779B97F4A7C15)
BREAK = "\0"  # between texts
WORD = re.compile(r"[^\W_]+")


def search_blocks(chunks: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, chunk_id, title, ordinal, title_hits, lexical_hits, positions): at least the n best chunks of each query, by hits in the
    title, hits at all, matching word positions, title, ordinal and chunk_id. ``queries`` has query_id and terms."""
    texts = chunks.select("chunk_id", "title", "ordinal", F.lower("title").alias("low_title"), F.lower("content").alias("low"))
    asked = stored(queries.where("query_id IS NOT NULL").select("query_id", "terms"), "asked-terms")
    chars = texts.agg(F.coalesce(F.sum(F.length("low")), F.lit(0))).first()[0]
    blocks, shares = max(1, -(-asked.count() // BLOCK_QUERIES)), max(1, -(-chars // SHARE_CHARS))

    def dealt(df: DataFrame, by: str, name: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(count)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    pairs = shares * blocks
    left = dealt(texts, "chunk_id", "share", shares, "block", blocks).repartition(pairs, "share", "block")
    right = dealt(asked, "query_id", "block", blocks, "share", shares).repartition(pairs, "share", "block")
    schema = T.StructType([asked.schema["query_id"], *texts.schema.fields[:3], *[
        T.StructField(name, T.IntegerType()) for name in ("title_hits", "lexical_hits", "positions")]])

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        if not rows.num_rows or not wanted.num_rows:
            return kind.empty_table()
        rows = rows.take(pc.sort_indices(
            rows, sort_keys=[(c, "ascending") for c in ("title", "ordinal", "chunk_id")], null_placement="at_start"))
        found = []
        for query, row, sums, (title, hit) in _block_hits(rows, wanted["terms"].combine_chunks(), n):
            parts = [sums >> title, (sums >> hit) & ((1 << (title - hit)) - 1), sums & ((1 << hit) - 1)]
            named = rows.select(["chunk_id", "title", "ordinal"]).take(pa.array(row))
            found.append(pa.Table.from_arrays([wanted["query_id"].take(pa.array(query)), *named.columns, *[
                pa.array(p.astype(np.int32)) for p in parts]], names=kind.names).cast(kind))
        return pa.concat_tables(found)

    return left.groupBy("share", "block").cogroup(right.groupBy("share", "block")).applyInArrow(run, schema)


def _block_hits(rows: pa.Table, asked: pa.Array, n: int):
    """(query, row, sum, places of the sum's parts) of each query's n best, ties to the smaller row: hits in the title, hits and word positions in
    one number.

    Sums are made for a tile of chunks and a step of queries. Only those above a query's n-th best so far are kept.
    """
    asked = asked.cast(pa.list_(pa.string()))
    coded = asked.flatten().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    size = pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False)
    wide = np.full((len(asked), size.max()), len(terms))  # the number behind the last term stands for none
    wide[np.arange(size.max()) < size[:, None]] = coded.indices.to_numpy()
    longer = np.argsort(size, kind="stable")  # a step's queries are of like length
    wide, size = wide[longer], size[longer]
    titles, texts = [[t or "" for t in rows[c].to_pylist()] for c in ("low_title", "low")]
    small = size.max() < 64 and max(map(len, texts)) < 1 << 19
    title, hit, kind = (25, 19, np.int32) if small else (50, 40, np.int64)
    in_text, whole = _holds(texts, terms)
    in_title, _ = _holds(titles, terms)
    step = max(1, STEP_SUMS // TILE)
    floor = np.zeros(len(wide), kind)
    query, row, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    new, due = [], 1
    matrix, buffer = np.empty((len(terms) + 1, TILE), kind), np.empty((step, TILE), kind)
    for number, first in enumerate(range(0, len(texts), TILE), 1):
        matrix[:] = 0
        for (chunk, term, *counts), value in ((in_text, 1 << hit), (in_title, (1 << title) + (1 << hit)), (whole, None)):
            cut = slice(*np.searchsorted(chunk, (first, first + TILE)))
            if value:
                matrix[term[cut], chunk[cut] - first] = value
            else:
                np.add.at(matrix, (term[cut], chunk[cut] - first), counts[0][cut].astype(kind))
        for at in range(0, len(wide), step):
            part = wide[at:at + step, :size[min(at + step, len(wide)) - 1]]
            sums = np.zeros((len(part), TILE), kind)
            for j in range(part.shape[1]):
                sums += np.take(matrix, part[:, j], axis=0, out=buffer[:len(part)], mode="clip")
            if number == 1 and TILE > n:  # else a query's first tile would be kept whole
                floor[at:at + step] = np.maximum(np.partition(sums, TILE - n, axis=1)[:, TILE - n] - 1, 0)
            found = np.nonzero(sums > floor[at:at + step, None])
            new.append((found[0] + at, found[1] + first, sums[found]))
        if number >= due or first + TILE >= len(texts):
            query, row, best = (np.concatenate(x) for x in zip((query, row, best), *new, strict=True))
            new, due = [], 2 * number
            order = np.lexsort((row, -best, query))
            query, row, best = query[order], row[order], best[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            query, row, best, place = (x[place < n] for x in (query, row, best, place))
            floor[:] = 0
            floor[query[place == n - 1]] = best[place == n - 1]  # later rows lose ties
    yield longer[query], row, best, (title, hit)


def _holds(texts: list[str], terms: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, term) numbers of the terms inside each text, by text; a term inside it several times comes several times. And (text, term, 1) for
    each place where a whole word is a term.

    Those with the wildcard '_' are looked for in each text, all others in many texts at once.
    """
    plain = {t: i for i, t in enumerate(terms) if t and "_" not in t and BREAK not in t}
    groups = [_Group(np.array([i for t, i in plain.items() if len(t) == size]), [t for t in plain if len(t) == size])
              for size in sorted({len(t) for t in plain})]
    ends = np.cumsum([len(t) + 1 for t in texts])
    first, found = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    while first < len(texts) and groups:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_CHARS, "right")))
        found += [(text + first, term, whole) for text, term, whole in _places(texts[first:last], groups)]
        first = last
    rest = [(i, j) for j, t in enumerate(terms) if t not in plain for i in _holding(texts, t)]
    more = np.array(rest, np.int64).reshape(-1, 2)
    text, term, whole = (np.concatenate(x) for x in zip(*found, (more[:, 0], more[:, 1], np.zeros(len(more), bool)), strict=True))
    order = np.argsort(text, kind="stable")
    text, term, whole = text[order], term[order], whole[order]
    return (text, term), (text[whole], term[whole], np.ones(whole.sum(), np.int64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class _Group:
    """Terms of one length, by the hash of their first letters."""

    def __init__(self, number: np.ndarray, terms: list[str]) -> None:
        codes = _codes("".join(terms)).reshape(len(terms), -1)
        self.size, self.hashed = codes.shape[1], min(codes.shape[1], LONG)
        value = np.zeros(len(terms), np.uint64)
        for j in range(self.hashed):
            value = value * BASE + codes[:, j]
        order = np.argsort(value, kind="stable")
        self.value, self.codes, self.number = value[order], codes[order], number[order]
        self.word = np.array([WORD.fullmatch(t) is not None for t in terms])[order]
        self.table = np.zeros(1 << 20, bool)
        self.table[self.value >> np.uint64(44)] = True


def _places(texts: list[str], groups: list[_Group]):
    """(text, term, whether it is a whole word) of all places of the groups' terms in the texts.

    The texts are one row of letters. The hash of s letters from each place on is made from that of s - 1; where it is a term's, the letters are
    compared.
    """
    longest = max(g.size for g in groups)
    codes = _codes(BREAK + BREAK.join(texts) + BREAK * (longest + 1))
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    letters = np.bincount(codes) > 0
    letters[letters] = [WORD.fullmatch(chr(c)) is not None for c in np.flatnonzero(letters)]
    letter = letters[codes]
    value = np.zeros(len(codes), np.uint64)
    for size in range(1, min(longest, LONG) + 1):
        value = value[:len(codes) - size + 1] * BASE + codes[size - 1:]
        for group in (g for g in groups if g.hashed == size):
            place = np.flatnonzero(group.table[value >> np.uint64(44)])
            place = place[place + group.size < len(codes)]
            left, right = (np.searchsorted(group.value, value[place], side) for side in ("left", "right"))
            many = right - left
            place, term = np.repeat(place, many), np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            same = np.ones(len(place), bool)
            for j in range(group.size):
                same &= codes[place + j] == group.codes[term, j]
            place, term = place[same], term[same]
            yield (np.searchsorted(starts, place, "right") - 1, group.number[term],
                   group.word[term] & ~letter[place - 1] & ~letter[place + group.size])


def _holding(texts: list[str], term: str) -> list[int]:
    """Numbers of the texts that have the term; '_' is any one character."""
    needle = max(term.split("_"), key=len)
    pattern = re.compile(".".join(map(re.escape, term.split("_"))), re.DOTALL)
    return [i for i, text in enumerate(texts) if needle in text and pattern.search(text)]
