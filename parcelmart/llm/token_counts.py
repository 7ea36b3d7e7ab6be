"""Token counts by whole-token lookup.

Before any text is read, the library is asked which strings of the vocabulary encode alone as one token.
A chunk of text that is such a string counts one, without merging; only the rest is merged.

Null and empty texts have 0 bytes and 0 tokens. Rows are never joined or grouped, so repeated rows and ties
give one result row each.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from parcelmart.llm.pieces import CACHED_LENGTH, SPACE, Recent, chunks, processor, vocabulary
from parcelmart.llm.texts import per_text


@lru_cache(maxsize=1)
def whole_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that the library encodes as exactly that one token.

    A string that starts with the space sign is encoded as a text of its own. Any other is put
    behind a line break; the break is in no piece of more than one character, so nothing merges over it.
    """
    words, library = vocabulary(path), processor(path)
    if any("\n" in pair for pair in words.inside):
        raise ValueError("a piece of this vocabulary holds a line break beside another character")
    names = list(words.ids)
    asked = [p[1:].replace(SPACE, " ") if p[0] == SPACE and len(p) > 1 else "\n" + p.replace(SPACE, " ") for p in names]
    head = library.encode("\n", num_threads=1) if asked else []
    found = library.encode(asked, num_threads=1)
    return frozenset(
        p for p, a, ids in zip(names, asked, found, strict=True)
        if ids == ([words.ids[p]] if a[:1] != "\n" else [*head, words.ids[p]])
    )


class Counter:
    """Token numbers of whole texts."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known = Recent({p[1:]: 1 for p in whole_tokens(path) if p[0] == SPACE})

    def texts(self, texts: list[str]) -> list[int]:
        split = [chunks(t) for t in texts]
        missing = self.known.fetch(set().union(*split))
        merged = self.vocabulary.encode_many([SPACE + c for c in missing])
        self.known.update((c, len(merged[SPACE + c])) for c in missing)
        out = [sum(map(self.known.__getitem__, c)) for c in split]
        for chunk in [c for c in missing if len(c) > CACHED_LENGTH]:
            del self.known[chunk]
        self.known.turn()
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text."""

    def make():
        counter = Counter(path)

        def run(texts: list[bytes]) -> list:
            n = counter.texts([t.decode("utf-8", "replace") for t in texts])
            return [[len(t) for t in texts], n, [x > limit for x in n]]

        return run

    return per_text(docs, make, "n_bytes long, n_tokens long, over_limit boolean", keep)
