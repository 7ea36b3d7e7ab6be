"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes chunks that no piece can cross, and each chunk is merged by an agenda of adjacent
symbol pairs ordered by score, then by place. The agendas of all short chunks of an Arrow batch are rows of one
matrix, from which each round takes every row's best pair; a long chunk has a heap. Chunks are looked up in
a bounded cache first. Every chunk that was merged is compared with the sentencepiece library's own
encoding, in one call per batch.

Null and empty texts have no tokens and decode to the empty text. Repeated rows give repeated rows. Text of
any length is one row; a chunk without spaces of n characters takes O(n log n) steps.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from parcelmart.llm.texts import per_text

SPACE = "▁"
CACHED_CHUNKS = 250_000
CACHED_LENGTH = 64
#: Chunks of up to so many characters are merged together, so many at a time.
WIDTHS, ROWS = (8, 16, 32), 20_000
NEVER = 1 << 40
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


@lru_cache(maxsize=1)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Vocabulary:
    """Pieces of a merge-type model, and the pairs of characters that stand inside some piece.

    Merging only ever makes pieces of the vocabulary, so two characters that no piece holds side by side
    always end up in different tokens: a text may be cut between them. No piece may hold a space
    after another character; then a text may be cut before every run of spaces.
    """

    def __init__(self, path: str):
        library = processor(path)
        self.ids: dict[str, int] = {}
        self.order: dict[str, float] = {}
        self.bytes_: dict[int, int] = {}
        self.unknown = library.unk_id()
        self.library_size = library.get_piece_size()
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes_[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
                self.order[piece] = -library.get_score(i)
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(b[1] == SPACE and b[0] != SPACE for b in self.inside):
            raise ValueError("a piece of this vocabulary holds a space after another character")
        ranks = {score: i for i, score in enumerate(sorted(set(self.order.values())))}
        pairs = sorted(
            (self.ids[p[:i]] << 32 | self.ids[p[i:]], ranks[self.order[p]], self.ids[p])
            for p in self.ids for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids
        )
        self.pairs, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.symbols = np.arange(0x110000, dtype=np.int64) + self.library_size  # characters outside
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i

    def merge(self, chunk: str) -> list[str]:
        """Symbols of a chunk after all merges: best score first, then leftmost."""
        symbols, order, n = list(chunk), self.order, len(chunk)
        agenda = [(order[p], i, p) for i in range(n - 1) if (p := chunk[i:i + 2]) in order]
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, left, piece = heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != piece:
                continue  # one of the two has been merged with another symbol
            symbols[left], symbols[right] = piece, ""
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (p := piece + symbols[following]) in order:
                    heappush(agenda, (order[p], left, p))
            if (previous := before[left]) >= 0 and (p := symbols[previous] + piece) in order:
                heappush(agenda, (order[p], previous, p))
        return [s for s in symbols if s]

    def cut(self, chunk: str) -> list[str]:
        """The chunk cut wherever no piece can stand across."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1:i + 1] not in inside:
                out.append(chunk[start:i])
                start = i
        out.append(chunk[start:])
        return out

    def outside(self, symbol: str) -> list[int]:
        """Ids of a character that is no piece: those of its bytes, or else the unknown id."""
        return [self.bytes_[b] for b in symbol.encode()] if self.bytes_ else [self.unknown]

    def encode(self, chunk: str) -> tuple[int, ...]:
        out = []
        for part in self.cut(chunk):
            for symbol in self.merge(part):
                out += (self.ids[symbol],) if symbol in self.ids else self.outside(symbol)
        return tuple(out)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that two symbols make (NEVER if none), and its place in ``made``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER), at

    def merge_rows(self, chunks: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of chunks of at most ``width`` characters after all merges, one after the other, and their numbers."""
        n = len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, n)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[np.arange(width + 1) < sizes[:, None]] = self.symbols[codes]
        rank = np.where(symbol[:, 1:] >= 0, self.look_up(symbol[:, :-1], np.maximum(symbol[:, 1:], 0))[0], NEVER)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)
        while rows.size:
            left = rank[rows].argmin(axis=1)  # the leftmost of equal ones
            more = rank[rows, left] < NEVER
            rows, left = rows[more], left[more]
            right = after[rows, left]
            piece = self.made[self.look_up(symbol[rows, left], symbol[rows, right])[1]]
            symbol[rows, left], symbol[rows, right] = piece, -1
            following = np.minimum(after[rows, right], width)
            after[rows, left], before[rows, following] = following, left
            rank[rows, np.minimum(right, width - 1)] = NEVER
            other = symbol[rows, following]
            rank[rows, left] = np.where(other >= 0, self.look_up(piece, np.maximum(other, 0))[0], NEVER)
            previous = before[rows, left]
            has = previous >= 0
            at, before_it = rows[has], previous[has]
            rank[at, before_it] = self.look_up(symbol[at, before_it], piece[has])[0]
        there = symbol >= 0
        return symbol[there], there.sum(axis=1)

    def encode_many(self, chunks: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each of the chunks."""
        found = {}
        by_width: dict[int, list[str]] = {w: [] for w in WIDTHS}
        for chunk in chunks:
            width = next((w for w in WIDTHS if len(chunk) <= w), None)
            if width is None:
                found[chunk] = self.encode(chunk)
            else:
                by_width[width].append(chunk)
        for width, all_rows in by_width.items():
            for start in range(0, len(all_rows), ROWS):
                rows = all_rows[start:start + ROWS]
                symbols, counts = self.merge_rows(rows, width)
                flat, ends = symbols.tolist(), np.cumsum(counts).tolist()
                low = 0
                for chunk, high in zip(rows, ends, strict=True):
                    found[chunk] = tuple(flat[low:high])
                    low = high
                for i in np.unique(np.searchsorted(ends, np.flatnonzero(symbols >= self.library_size), "right")).tolist():
                    chunk = rows[i]
                    found[chunk] = tuple(chain.from_iterable(
                        (s,) if s < self.library_size else self.outside(chr(s - self.library_size)) for s in found[chunk]))
        return found


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunks(text: str) -> list[str]:
    """A text's chunks, each without the space sign it starts with (the library puts one before the text)."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and SPACE not in text:
        return text.split(" ")
    return [c[1:] for c in _RUNS.findall(SPACE + text.replace(" ", SPACE))]


class Recent(dict):
    """Values for the chunks of late: those of the last and the present generation of CACHED_CHUNKS each."""

    def __init__(self, start: dict | None = None):
        self.start, self.old = start or {}, {}
        super().__init__(self.start)

    def fetch(self, wanted: set) -> list:
        """The chunks of ``wanted`` without a value; those of the last generation are taken over."""
        missing = wanted.difference(self)
        again = missing.intersection(self.old)
        self.update((c, self.old[c]) for c in again)
        return list(missing.difference(again))

    def turn(self) -> None:
        if len(self) > CACHED_CHUNKS:
            self.old = dict(self)
            self.clear()
            self.update(self.start)


class Encoder:
    """Whole texts to ids."""

    def __init__(self, path: str):
        self.vocabulary, self.library = vocabulary(path), processor(path)
        self.known, self.differences = Recent(), 0

    def texts(self, texts: list[str]) -> list[list[int]]:
        split = [chunks(t) for t in texts]
        missing = self.known.fetch(set().union(*split))
        found = self.vocabulary.encode_many([SPACE + c for c in missing])
        theirs = self.library.encode([c.replace(SPACE, " ") for c in missing], num_threads=1)
        for chunk, ids in zip(missing, theirs, strict=True):
            own = found[SPACE + chunk]
            if chunk and list(own) != ids:  # the library gives an empty text no space sign
                self.differences, own = self.differences + 1, tuple(ids)
            self.known[chunk] = own
        out = [list(chain.from_iterable(map(self.known.__getitem__, c))) for c in split]
        for chunk in [c for c in missing if len(c) > CACHED_LENGTH]:
            del self.known[chunk]
        self.known.turn()
        return out


def encode_and_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids (array<int>) of every text, and the text decoded from them by the library."""

    def make():
        encoder = Encoder(path)

        def run(texts: list[bytes]) -> list:
            ids = encoder.texts([t.decode("utf-8", "replace") for t in texts])
            return [ids, encoder.library.decode(ids) if ids else []]

        return run

    return per_text(docs, make, "ids array<int>, decoded string", keep)


def round_trip_digests(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digests of ids and decoded text per row, made where the ids are, so that no id leaves its task.

    n_differences counts chunks of the row's slice that the library encodes otherwise (its ids are taken).
    """

    def make():
        encoder = Encoder(path)
        names = [str(i) for i in range(encoder.library.get_piece_size())].__getitem__

        def run(texts: list[bytes]) -> list:
            known = encoder.differences
            ids = encoder.texts([t.decode("utf-8", "replace") for t in texts])
            decoded = encoder.library.decode(ids)
            return [
                [len(i) for i in ids],
                [hashlib.sha256(",".join(map(names, i)).encode()).hexdigest() for i in ids],
                [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                [d.encode() == t for d, t in zip(decoded, texts, strict=True)],
                [encoder.differences - known] * len(texts),
            ]

        return run

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean, n_differences long"
    return per_text(docs, make, fields, keep)
