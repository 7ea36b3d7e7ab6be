"""An FM-index over sequences of small integers, in numpy: wavelet-tree ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector per bit of the symbols, kept level by level (a wavelet matrix)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int64)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(values) - int(before[-1])))
            values = np.concatenate((values[~ones], values[ones]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros_like(ends), ends
        for bit, before, zeros in self.levels:
            one = (symbols >> bit & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low

    def at(self, places: np.ndarray) -> np.ndarray:
        """The symbols at these places."""
        found = np.zeros_like(places)
        for bit, before, zeros in self.levels:
            one = before[places + 1] > before[places]
            found |= one.astype(np.int64) << bit
            places = np.where(one, zeros + before[places], places - before[places])
        return found


class FMIndex:
    """Index of segments of symbols (1 or more, below 2**bits - 1); each segment ends with a mark of its own.

    As the marks differ and are less than every symbol, suffixes are in order once the longest segment is compared;
    prefix doubling starts from three symbols at a time.
    """

    def __init__(self, segments: list[np.ndarray], bits: int):
        n = sum(map(len, segments)) + len(segments)
        text, unique = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place, longest = 0, 1
        for i, s in enumerate(segments):
            text[place:place + len(s)] = s
            unique[place:place + len(s)] = s + len(segments)
            unique[place + len(s)] = i
            place += len(s) + 1
            longest = max(longest, len(s) + 1)
        span = int(unique.max()) + 1
        self.size = n
        if span**3 < 1 << 62:
            key, depth = (unique * span + np.roll(unique, -1)) * span + np.roll(unique, -2), 3
        else:
            key, depth = unique * span + np.roll(unique, -1), 2
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = new
            if depth >= longest or new[-1] == n - 1:
                break
            key = rank * n + np.roll(rank, -depth)
            depth *= 2
        last = text[order - 1]
        self.tree = WaveletTree(last, bits)
        counts = np.bincount(text, minlength=1 << bits)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.sampled = order % SAMPLE == 0
        self.sampled |= last == 0  # a step back over a mark would leave the segment
        self.number = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) rows of the suffixes that start with each phrase (a row of symbols), searched backwards."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            alive = np.flatnonzero(low < high)
            if not alive.size:
                break
            symbols = phrases[alive, column]
            ranks = self.tree.rank(np.tile(symbols, 2), np.concatenate((low[alive], high[alive])))
            low[alive] = self.before[symbols] + ranks[:alive.size]
            high[alive] = self.before[symbols] + ranks[alive.size:]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled row, and adds the steps."""
        found, steps = np.full(len(rows), -1, np.int64), 0
        waiting, rows = np.arange(len(rows)), rows.copy()
        while waiting.size:
            there = self.sampled[rows]
            found[waiting[there]] = self.positions[self.number[rows[there]]] + steps
            waiting, rows = waiting[~there], rows[~there]
            symbols = self.tree.at(rows)
            rows = self.before[symbols] + self.tree.rank(symbols, rows)
            steps += 1
        return found
