"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them.

The trees are grown on histograms in numpy from a bounded sample of labelled documents and flattened to arrays of nodes,
which score a batch of documents level by level. Features in FALLING may only lower a score as they grow.

A null or empty text has no words and fails the limits. Without labels of both kinds every document that meets the
limits is kept. Repeated rows are judged alike; a document with several labels counts once per label.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmart.llm.texts import filter_rows, per_text

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: At most so many labelled documents are taken to fit the trees (those with the smallest hash of doc_id).
MAX_LABELLED = 20_000
#: Of the labelled documents called good, at least this share scores above the threshold.
KEPT_OF_GOOD = 0.999
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share",
    "shout_share", "digit_share", "line_words", "common_word", "distinct_share", "long_word_share",
)
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "shout_share")


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(BASE, FEATURES) of a text. Words are runs without ASCII white space."""
    words = text.encode().split()
    n = len(words)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    chars = len(text) - blanks
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")] if n else []
    duplicates = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(seen := set(windows)) < len(windows):
            number = {w: i for i, w in enumerate(seen)}
            at = np.fromiter(map(number.__getitem__, windows), np.int64, n - 2)
            twice = np.flatnonzero(np.bincount(at)[at] > 1)
            covered = np.zeros(n, bool)
            for step in range(3):
                covered[twice + step] = True
            repeated = int(covered.sum())
    counted = Counter(words)
    letters = max(chars, 1)
    upper = sum(map(str.isupper, text))
    return (n, chars, symbols, duplicates, repeated), (
        float(np.log1p(n)), chars / max(n, 1), symbols / letters, duplicates / max(len(lines), 1), repeated / max(n, 1),
        upper / letters, sum(map(text.count, ".,;:")) / max(n, 1), text.count("!") / max(n, 1),
        sum(map(text.count, "0123456789")) / letters, n / max(len(lines), 1),
        counted.most_common(1)[0][1] / n if n else 0.0, len(counted) / max(n, 1),
        sum(1 for w in counted if len(w) > 20) / max(len(counted), 1),
    )


def base_failed(base: tuple[int, ...]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > 50 * base[0]


@dataclass
class Trees:
    """Nodes of all trees in flat arrays: rows go left where the feature is at most the cut; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of quality for each row of FEATURES."""
        total = np.full(len(rows), self.start)
        if not len(self.roots) or not len(rows):
            return total
        node = np.tile(self.roots, (len(rows), 1))
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = np.where(rows[at, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return total + self.value[node].sum(axis=1)


def fit(
    rows: np.ndarray, good: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
    l2: float = 1.0, least: float = 2.0,
) -> Trees:
    """Boosted trees for the logistic loss.

    At a split on a falling feature the right value may not exceed the left, and the middle between the two bounds all
    leaves below on either side, so the whole tree falls in that feature.
    """
    rate_good = float(good.mean()) if len(good) else 0.5
    one_kind = not len(good) or rate_good in (0.0, 1.0)
    start = 0.0 if one_kind else float(np.log(rate_good / (1 - rate_good)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if one_kind:
        empty = np.zeros(0)
        return Trees(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, empty.astype(int), start, 0)
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    falling = [name in FALLING for name in FEATURES]
    margin = np.full(len(rows), start)

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        me = len(value)
        total_g, total_h = g[at].sum(), h[at].sum()
        for column, x in ((feature, 0), (cut, 0.0), (left, me), (right, me),
                          (value, float(np.clip(-total_g / (total_h + l2), low, high)) * rate)):
            column.append(x)
        if level == depth:
            return me
        best = None
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gs = np.cumsum(np.bincount(binned[at, f], g[at], len(e) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[at, f], h[at], len(e) + 1))[:-1]
            lv = np.clip(-gs / (hs + l2), low, high)
            rv = np.clip(-(total_g - gs) / (total_h - hs + l2), low, high)
            gain = -(gs * lv + 0.5 * (hs + l2) * lv**2) - ((total_g - gs) * rv + 0.5 * (total_h - hs + l2) * rv**2)
            bad = (hs < least) | (total_h - hs < least)
            if falling[f]:
                bad |= rv > lv
            gain[bad] = -np.inf
            k = int(gain.argmax())
            if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, lv[k], rv[k])
        own = -(total_g * value[me] / rate + 0.5 * (total_h + l2) * (value[me] / rate) ** 2)
        if best is None or best[0] <= own + 1e-9:
            return me
        _, f, k, lv, rv = best
        goes_left = binned[at, f] <= k
        middle = (lv + rv) / 2
        bounds = ((middle, high), (low, middle)) if falling[f] else ((low, high), (low, high))
        feature[me], cut[me] = f, float(edges[f][k])
        left[me] = grow(at[goes_left], g, h, *bounds[0], level + 1)
        right[me] = grow(at[~goes_left], g, h, *bounds[1], level + 1)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(rows)), p - good, p * (1 - p), -4.0, 4.0, 0))
        node = np.full(len(rows), roots[-1])
        f_, c_, l_, r_, v_ = (np.array(x) for x in (feature, cut, left, right, value))
        for _ in range(depth):
            node = np.where(rows[np.arange(len(rows)), f_[node]] <= c_[node], l_[node], r_[node])
        margin += v_[node]
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots), start, depth)


def document_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """BASE columns and FEATURES as an array."""

    def make():
        def run(texts: list[bytes]) -> list:
            found = [statistics(t.decode("utf-8", "replace")) for t in texts]
            return [*([b[i] for b, _ in found] for i in range(len(BASE))), [list(f) for _, f in found]]

        return run

    return per_text(docs, make, ", ".join(f"{b} long" for b in BASE) + ", features array<double>", keep)


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Trees, float]:
    """Trees and threshold from at most ``max_labelled`` labelled documents (some megabytes of numbers on the driver)."""
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .select("doc_id", F.col("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled))
    # max_labelled rows of two numbers: bounded by the parameter
    # max_labelled rows at most; of a repeated doc_id the text with the least hash
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("quality", "least.text")
    found = document_statistics(texts, ("quality",)).select("quality", "features").toPandas()
    features = np.array(found["features"].tolist(), float).reshape(-1, len(FEATURES))
    good = found["quality"].to_numpy(float)
    order = np.lexsort((*features.T, good))  # the order in which rows arrive changes nothing
    features, good = features[order], good[order]
    trees = fit(features, good)
    scores = trees.score(features[good == 1])
    return trees, min(0.0, float(np.quantile(scores, 1 - KEPT_OF_GOOD)) - 1e-9) if len(scores) else -np.inf


def verdicts(trees: Trees, threshold: float):
    """texts -> (statistics, scores, kept)."""

    def run(texts: list[bytes]):
        found = [statistics(t.decode("utf-8", "replace")) for t in texts]
        scores = trees.score(np.array([f for _, f in found], float).reshape(len(found), len(FEATURES)))
        failed = [base_failed(b) for b, _ in found]
        return found, scores, failed, [not x and bool(s >= threshold) for x, s in zip(failed, scores, strict=True)]

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Base statistics, base_failed, the trees' score (log-odds) and kept for every document."""
    trees, threshold = fit_on_labels(docs, labels)

    def make():
        judge = verdicts(trees, threshold)

        def run(texts: list[bytes]) -> list:
            found, scores, failed, kept = judge(texts)
            return [*([b[i] for b, _ in found] for i in range(len(BASE))), failed, scores.tolist(), kept]

        return run

    fields = ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, quality_score double, kept boolean"
    return per_text(docs, make, fields, keep)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the rules keep."""
    trees, threshold = fit_on_labels(docs, labels)

    def make():
        judge = verdicts(trees, threshold)
        return lambda texts: judge(texts)[3]

    return filter_rows(docs, make)
