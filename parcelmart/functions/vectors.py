"""Vectors: hashed embeddings, cosine similarity, sign codes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmart.functions.tokens import python_tokens

DIMENSIONS = 384
MIN_DIMENSIONS = 32
STORED_DECIMALS = 8
SLICE_CHARS = 1 << 20  # characters of text whose tokens are held at once


def _digest(kind: str) -> Callable[[bytes], bytes]:
    if kind == "blake2b":
        return lambda data: hashlib.blake2b(data, digest_size=16).digest()
    return lambda data: hashlib.new(kind, data).digest()


def embed_token_lists(token_lists: pd.Series, dimensions: int, kind: str) -> np.ndarray:
    """One row per token list. Each distinct token of the batch is hashed once."""
    sizes = np.fromiter((len(t) if isinstance(t, list) else 0 for t in token_lists), dtype=np.int64, count=len(token_lists))
    out = np.zeros((len(token_lists), dimensions))
    if not sizes.sum():
        return out
    flat = np.concatenate([np.asarray(t, dtype=object) for t in token_lists if isinstance(t, list) and t])
    codes, distinct = pd.factorize(flat)
    digest = _digest(kind)
    hashes = [digest(token.encode("utf-8")) for token in distinct]
    bucket = np.fromiter((int.from_bytes(h[:8], "little") % dimensions for h in hashes), np.int64, len(hashes))
    sign = np.fromiter((1.0 if h[8] & 1 else -1.0 for h in hashes), float, len(hashes))
    rows = np.repeat(np.arange(len(token_lists)), sizes)
    pair, count = np.unique(rows * len(distinct) + codes, return_counts=True)
    row, token = pair // len(distinct), pair % len(distinct)
    weight = sign[token] * (1.0 + np.log1p(count))
    out = np.bincount(row * dimensions + bucket[token], weights=weight, minlength=out.size).reshape(out.shape)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def _slices(texts: pd.Series) -> Iterator[pd.Series]:
    """Neighbouring texts, SLICE_CHARS together or one text that is longer."""
    ends = texts.str.len().fillna(0).astype(np.int64).cumsum().to_numpy()
    first = 0
    while first < len(texts):
        so_far = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, so_far + SLICE_CHARS, "right")))
        yield texts.iloc[first:last]
        first = last


def hash_embedding(text: Column | str, dimensions: int = DIMENSIONS, kind: str = "blake2b") -> Column:
    """Feature-hashing embedding of a text, unit length, all zero without tokens.

    One Arrow round trip from text to vector. ``kind`` names the digest; the default is the one stored
    vectors use. Tokens take some thirty times the memory of their text, so a batch is embedded in slices.
    """
    if dimensions < MIN_DIMENSIONS:
        raise ValueError(f"dimensions must be at least {MIN_DIMENSIONS}")

    @F.pandas_udf("array<float>")
    def embed(batch: pd.Series) -> pd.Series:
        rows = []
        for part in _slices(batch):
            tokens = part.map(python_tokens, na_action="ignore")
            rows += list(np.round(embed_token_lists(tokens, dimensions, kind), STORED_DECIMALS).astype(np.float32))
        return pd.Series(rows, dtype=object)

    return embed(text)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(left: Column, right: Column) -> Column:
    """0 if either vector is all zero; an error for vectors of unequal length."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(left, right) / norms)
    return F.when(F.size(left) == F.size(right), value).otherwise(
        F.raise_error(F.lit("vectors must have the same dimensions")).cast("double")
    )


def hyperplanes(dimensions: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, bits))


def sign_codes(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return ((vectors @ planes) > 0) @ (1 << np.arange(planes.shape[1]))
