"""Benchmark decontamination by an FM-index of each shard of training documents.

Benchmark texts become phrases (windows of words). A shard is a slice of an Arrow batch. Its text is
reduced to what can hold a phrase: stretches of words that occur in phrases, at least as long as the shortest
phrase, cut into overlapping segments. All phrases are searched backwards at once through the index's wavelet-tree ranks,
occurrences are located by sampled suffix positions, and their spans are merged per document.

The benchmark goes to the tasks in blocks of about BLOCK_BYTES of text; each further block is one more pass over the
documents, which carries the spans found so far.

Null and empty texts have no words and no hits; such benchmark items have no phrase. Repeated documents are reported
each; repeated items count once. A null item_id can hit words, but isn't listed.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.fm_index import FMIndex
from parcelmart.llm.texts import per_text, replace_texts, written

WINDOW = 10
BLOCK_BYTES = 32_000_000
#: Words of a segment besides those it shares with the next.
STEP = 38
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to lower case, all that ends a word to a space.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Phrases:
    """Windows of benchmark items as rows of word numbers (from 1), by length."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            numbers = [self.words.setdefault(w, len(self.words) + 1) for w in text.translate(_PLAIN).split()]
            for i in range(max(len(numbers) - window, 0) + 1 if numbers else 0):
                owners.setdefault(tuple(numbers[i:i + window]), set()).update(() if name is None else (name,))
        self.by_length: dict[int, tuple[np.ndarray, list[frozenset[str]]]] = {}
        for length in sorted({len(p) for p in owners}):
            rows = [p for p in owners if len(p) == length]
            self.by_length[length] = np.array(rows, np.int64), [frozenset(owners[p]) for p in rows]
        self.shortest, self.longest = min(self.by_length, default=0), max(self.by_length, default=0)
        self.bits = max(len(self.words) + 1, 2).bit_length()

    def hits(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each list of words: merged (first word, end) spans that phrases cover, and the items hit."""
        found: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        segments, origin = [], []
        number = self.words.get
        for doc, words in enumerate(texts if self.by_length else []):
            if len(words) < self.shortest:
                continue
            ids = np.fromiter((number(w, 0) for w in words), np.int64, len(words))
            known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
            change = np.diff(known)
            starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            long_enough = ends - starts >= self.shortest
            for a, b in zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True):
                for low in range(a, max(b - self.longest + 1, a + 1), STEP):
                    segments.append(ids[low:min(low + STEP + self.longest - 1, b)])
                    origin.append((doc, low))
        if not segments:
            return found
        index = FMIndex(segments, self.bits)
        firsts = np.concatenate(([0], np.cumsum([len(s) + 1 for s in segments])[:-1]))
        for length, (rows, owners) in self.by_length.items():
            low, high = index.search(rows)
            counts = high - low
            hit = np.repeat(np.arange(len(rows)), counts)
            within = np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts)
            places = index.locate(low[hit] + within)
            which = np.searchsorted(firsts, places, "right") - 1
            for phrase, segment, at in zip(hit.tolist(), which.tolist(), (places - firsts[which]).tolist(), strict=True):
                doc, first = origin[segment]
                found[doc][0].append((first + at, first + at + length))
                found[doc][1].update(owners[phrase])
        return [(merge_spans(spans), names) for spans, names in found]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """(whether it is the last, phrases) of the benchmark's blocks of items, each read when it is asked for."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.where("text is not null").distinct()  # repeated items count once, in the size of blocks as well
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield block == blocks - 1, Phrases([(r["item_id"], bytes(r["text"])) for r in part.collect()], window)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (JSON list of first word and end)."""
    context = docs.sparkSession.sparkContext
    fields = "n_words long, spans string, items string"
    state = None
    for last, phrases in phrase_blocks(benchmark, window, block_bytes):
        shared = context.broadcast(phrases)
        keep = ("doc_id",) if last else ("doc_id", "text")

        def make(shared=shared):
            known = shared.value

            def run(texts: list[bytes]) -> list:
                words = [t.translate(_PLAIN).split() for t in texts]
                hits = known.hits(words)
                return [[len(w) for w in words], [json.dumps(s) for s, _ in hits], [json.dumps(sorted(n)) for _, n in hits]]

            return run

        if state is None:
            state = per_text(docs.select("doc_id", "text"), make, fields, keep)
        else:
            before = written(state.withColumnsRenamed({"spans": "spans_0", "items": "items_0"}), "hits")
            both = per_text(before, make, fields.replace("n_words", "n_again"), (*keep, "n_words", "spans_0", "items_0"))
            state = both.select(
                *keep, "n_words",
                F.concat(F.expr("left(spans_0, length(spans_0) - 1)"),
                         F.when((F.length("spans_0") > 2) & (F.length("spans") > 2), ", ").otherwise(""),
                         F.expr("substring(spans, 2)")).alias("spans"),
                F.to_json(F.array_union(F.from_json("items_0", "array<string>"), F.from_json("items", "array<string>"))).alias("items"))

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            spans = [merge_spans([tuple(x) for x in json.loads(s)]) for s in batch.column(2).to_pylist()]
            items = [sorted(json.loads(s)) for s in batch.column(3).to_pylist()]
            n_hit = [sum(b - a for a, b in s) for s in spans]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array([json.dumps(s) for s in spans], pa.string()),
            ], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return state.select("doc_id", "n_words", "spans", "items").mapInArrow(
        finish, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, their texts without any phrase of the benchmark.

    A text is searched again after a cut, as the words around it may form a phrase. Texts without a hit are unchanged.
    """
    context, size = docs.sparkSession.sparkContext, None
    while True:
        i = -1
        for i, (_, phrases) in enumerate(phrase_blocks(benchmark, window, block_bytes)):
            shared = context.broadcast(phrases)

            def make(shared=shared):
                known = shared.value

                def run(texts: list[bytes]) -> list[bytes]:
                    texts, check = list(texts), list(range(len(texts)))
                    while check:
                        hits = known.hits([texts[i].translate(_PLAIN).split() for i in check])
                        check = [(i, s) for i, (s, _) in zip(check, hits, strict=True) if s]
                        for i, spans in check:
                            texts[i] = cut_spans(texts[i], spans)
                        check = [i for i, _ in check]
                    return texts

                return run

            docs = replace_texts(written(docs, "decontaminated") if i else docs, make)
        if i < 1:
            return docs
        # a cut for one block may have made a phrase of another: until a round over all blocks cuts nothing
        docs = written(docs, "decontaminated")
        before, size = size, docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
        if size == before:
            return docs
