"""Token ids as Parquet list columns, in document order, read back selectively.

Layout: rows in ascending doc_id (nulls first, then by text), spread over part files in the same order. ``ids`` is
dictionary-encoded (a vocabulary fits one dictionary page), the number columns are delta-encoded; row groups
and pages are small, and pages carry column indexes, so a reader can fetch a range of documents, or the number
columns alone. ``part`` and ``offset`` say where a document starts within its part; the start over
all files is the part's base (a sum over one row per part) plus the offset.

Null and empty texts are one row with the end id only. Repeated rows are kept, each with its own start. Rows with
equal doc_id and text are interchangeable, so any order among them gives the same files.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelmart.llm.texts import limit_batches, scratch, slices

SCHEMA = "doc_id long, part int, offset long, n_tokens long, ids array<int>"
#: Writer options: format version 2 gives delta encoding where there is no dictionary.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
CACHED = 250_000
#: Spans that the library is asked in one text.
JOINED = 20_000
#: Text whose spans are looked up together.
ASKED_BYTES = 4_000_000
SPANS = pa.large_list(pa.large_string())
#: A single space between two visible characters starts a new pre-token in the byte-level pattern.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: In an ASCII text without these every white space is a single space or line break between visible characters.
_BLANKS = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
_MARKS = ".,!?;:|#$%&*"
_MARKED = rf"^(?P<word>\n?\pL+)(?P<marks>[{_MARKS}]+)$"
#: Whether a byte is a mark.
_ENDS = np.isin(np.arange(256), np.frombuffer(_MARKS.encode(), np.uint8))


@lru_cache(maxsize=1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def single_spaced(text: str) -> bool:
    """Whether every white space of the text stands alone between visible characters: cut before spaces and line breaks."""
    if text.isascii():
        single = not any(b in text for b in _BLANKS)
    else:
        words = text.split()
        single = sum(map(len, words)) + len(words) - 1 == len(text)
    return single and text[:1] not in ("", " ", "\n") and text[-1] not in " \n"


def spans(text: str) -> list[str]:
    """A text cut where the byte-level pattern always starts a new pre-token; all but the first without their space.

    That is before a single space with a visible character on either side. Python's white space includes the
    pattern's, so no cut is made inside a run of white space.
    """
    first, *rest = _CUT.split(text)
    return [first, *[s[1:] for s in rest]]


class Encoder:
    """Whole texts to ids by the tokenizers library, which is asked once for each span not seen lately.

    The spans of a list of texts are numbered by Arrow's dictionary encoding, so that only distinct ones are looked up,
    and the ids of all places are one take from the ids of the distinct spans. Ids of a span are kept as the bytes of
    32-bit integers. The spans of the last and the present generation of CACHED are remembered, over all tasks of a worker.
    """

    def __init__(self, path: str):
        self.library, self.known, self.old = tokenizer(path), {}, {}
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line_break = self.break_id()

    def break_id(self) -> int | None:
        """The id of a line break, if the library makes it a token of its own before a span, with and without a space.

        Then no span without a line break can have this id, and many spans can be asked as one text.
        """
        lone = self.library.encode("\n", add_special_tokens=False).ids
        if len(lone) != 1 or any(not c or set(c).intersection(" \n") for c in self.added):
            return None
        ends = ["a", "1", ".", "\u00e9", "\u6f22", "\U0001f600", "'s", "a.", "1a", "$"]
        for before in (" ", ""):
            found = self.library.encode_batch([before + s for s in ends], add_special_tokens=False)
            whole = self.library.encode("".join("\n" + before + s for s in ends), add_special_tokens=False).ids
            if whole != [i for e in found for i in (*lone, *e.ids)]:
                return None
        return lone[0]

    def ids_of(self, wanted: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(wanted, add_special_tokens=False)
        return [array("i", e.ids).tobytes() for e in found]

    def ask(self, wanted: list[str]) -> None:
        """Learns the ids of spans behind a space, or of lines: those of plain characters as one text, the others each alone."""
        plain, lines = [], []
        if self.line_break is not None:
            plain = [w for w in wanted if w.isprintable() and " " not in w]
            lines = [w for w in wanted if w[:1] == "\n" and w[1:].isprintable() and " " not in w]
            if any(c in "\n".join([*plain, *lines]) for c in self.added):
                plain, lines = ([w for w in some if not any(c in w for c in self.added)] for some in (plain, lines))
        for some, before in ((plain, "\n "), (lines, "")):
            for low in range(0, len(some), JOINED):
                part = some[low:low + JOINED]
                found = self.library.encode_batch_fast(["".join([before + w for w in part])], add_special_tokens=False)[0]
                ids = np.array(found.ids, np.int32)
                cuts = np.flatnonzero(ids == self.line_break) * 4
                if len(cuts) != len(part):
                    raise ValueError("a span without line breaks has the id of one")
                flat, starts, ends = ids.tobytes(), cuts + 4 * bool(before), np.append(cuts[1:], 4 * len(ids))
                self.known.update(zip(part, map(flat.__getitem__, map(slice, starts.tolist(), ends.tolist())), strict=True))
        if len(plain) + len(lines) < len(wanted):
            rest = [w for w in wanted if w not in self.known]
            self.known.update(zip(rest, self.ids_of([w if w[:1] == "\n" else " " + w for w in rest]), strict=True))

    def again(self, wanted: set[str]) -> set[str]:
        """Takes over what the last generation knows of ``wanted``; returns the rest."""
        found = wanted.intersection(self.old)
        self.known.update(zip(found, map(self.old.__getitem__, found), strict=True))
        return wanted.difference(found)

    def learn(self, wanted: list[str]) -> set[str]:
        """Sees to it that all spans (behind a space, but for line breaks) are known; returns those that were not."""
        missing = self.again(set(wanted).difference(self.known))
        self.ask(list(missing))
        return missing

    def behind_spaces(self, names: pa.Array) -> tuple[np.ndarray, pa.LargeListArray, set[str]]:
        """(places, lists, spans not known before): the ids of a span behind a space are those of the lists from its place to the next.

        Letters and the marks behind them are separate pre-tokens, so that only the letters are asked and remembered.
        """
        edges = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
        text = np.frombuffer(names.buffers()[2], np.uint8) if len(names) and names.buffers()[2] else np.zeros(0, np.uint8)
        marked = np.zeros(len(names), bool)
        filled = np.flatnonzero(edges[1:] > edges[:-1])
        marked[filled] = _ENDS[text[edges[1:][filled] - 1]]
        parts = pc.extract_regex(names.filter(pa.array(marked)), pattern=_MARKED)
        split = parts.is_valid().to_numpy(zero_copy_only=False)
        marked[marked] = split
        parts = parts.filter(pa.array(split))
        whole = pa.concat_arrays([names.filter(pa.array(~marked)), parts.field("word")]).dictionary_encode()
        marks = parts.field("marks").dictionary_encode()
        wanted = whole.dictionary.to_pylist()
        new = self.learn(wanted)
        lists = listed([*map(self.known.__getitem__, wanted), *self.ids_of(marks.dictionary.to_pylist())])
        ends = np.cumsum(1 + marked)
        order, words = np.empty(int(ends[-1]) if len(ends) else 0, np.int64), whole.indices.to_numpy()
        alone = len(names) - len(parts)
        order[ends[~marked] - 1], order[ends[marked] - 2] = words[:alone], words[alone:]
        order[ends[marked] - 1] = len(wanted) + marks.indices.to_numpy()
        return np.concatenate(([0], ends)), lists.take(pa.array(order)), new

    def texts(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as the bytes of native 32-bit integers."""
        if not texts:
            return []
        easy = [i for i, t in enumerate(texts) if single_spaced(t)]
        hard = sorted(set(range(len(texts))).difference(easy))
        lines = "\n" if self.line_break is None else " \n"
        split = [
            pc.split_pattern(pa.array([texts[i].replace("\n", lines) for i in easy], pa.large_string()), " ").cast(SPANS),
            pa.array([spans(texts[i]) for i in hard], SPANS),
        ]
        numbered = pa.concat_arrays([s.flatten() for s in split]).dictionary_encode()
        counts = np.concatenate([pc.list_value_length(s).to_numpy() for s in split])
        starts = np.cumsum(counts) - counts
        codes, names = numbered.indices.to_numpy(), numbered.dictionary
        firsts = listed(self.ids_of(names.take(pa.array(codes[starts])).to_pylist()))  # without a space before them
        codes = np.delete(codes, starts)
        behind = np.bincount(codes, minlength=len(names)) > 0
        names, codes = names.filter(pa.array(behind)), (np.cumsum(behind) - 1)[codes]
        codes = np.insert(codes, starts - np.arange(len(texts)), len(names) + np.arange(len(texts)))
        places, found, new = self.behind_spaces(names)
        edges = np.concatenate((found.offsets.to_numpy()[places], len(found.values) + firsts.offsets.to_numpy()[1:]))
        lists = pa.LargeListArray.from_arrays(pa.array(edges), pa.concat_arrays([found.values, firsts.values]))
        taken = lists.take(pa.array(codes))
        offsets, flat = taken.offsets.to_numpy(), taken.values.to_numpy()
        out = [b""] * len(texts)
        for i, a, b in zip(easy + hard, offsets[starts].tolist(), offsets[starts + counts].tolist(), strict=True):
            out[i] = flat[a:b].tobytes()
        for span in [s for s in new if len(s) > 64]:
            self.known.pop(span, None)
        if len(self.known) > CACHED:
            self.old, self.known = self.known, {}
        return out


def listed(ids: list[bytes]) -> pa.LargeListArray:
    """Ids as bytes of 32-bit integers as lists."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), pa.array(np.frombuffer(b"".join(ids), np.int32)))


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> None:
    """Writes doc_id, place and ids (``end_id`` last) of every document, ordered by doc_id.

    Texts are dealt by ranges of doc_id before they are encoded. A part that is written again after a
    lost executor has the same rows in the same order.
    """

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, offset = encoder_of(path), TaskContext.get().partitionId(), 0
        end = array("i", [end_id]).tobytes()
        for batch in batches:
            for start, texts in slices(batch.column(1), ASKED_BYTES):
                ids = encoder.texts([t.decode("utf-8", "replace") for t in texts])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + 1
                ends = np.cumsum(sizes)
                flat = np.frombuffer(end.join([*ids, b""]), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(np.full(len(texts), part, np.int32)),
                     pa.array(offset + ends - sizes), pa.array(sizes), lists],
                    names=["doc_id", "part", "offset", "n_tokens", "ids"],
                )
                offset += int(ends[-1])

    limit_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of a doc_id range; row groups and pages outside it are skipped by their statistics."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the ids before each document over all ``files``; reads number columns only.

    The running sum is over one row per part file.
    """
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def id_digests(files: DataFrame) -> DataFrame:
    """doc_id, part, offset, n_tokens and the CRC-32 of each document's ids as little-endian unsigned integers."""

    def run(batches):
        for batch in batches:
            lists = batch.column(4)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())],
                                             names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "part", "offset", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    write_tokens(docs, path, folder)
    files = read_tokens(spark, folder)
    return with_starts(id_digests(files), files).select("doc_id", "start", "n_tokens", "ids_crc32")
