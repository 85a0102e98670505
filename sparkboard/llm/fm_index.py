"""An FM-index over integer sequences: backward search through wavelet ranks, sampled locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``seq``, whose zeros each count as a symbol of
    their own, smaller than all others and ordered by place. Prefix doubling."""
    n = len(seq)
    zeros = seq == 0
    k = int(zeros.sum())
    rank = np.where(zeros, np.cumsum(zeros) - 1, seq.astype(np.int64) + (k - 1))
    step, top = 1, int(rank.max(initial=0)) + 1
    while True:
        ahead = np.full(n, 0, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (top + 1) + ahead
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1 or step >= n:
            return order
        step, top = 2 * step, int(fresh[-1]) + 1


class WaveletMatrix:
    """Ranks and access over symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels = max(1, int(top).bit_length())
        self.zeros: list[np.ndarray] = []  # of each level: zero bits before each place
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit == 0, out=before[1:])
            self.zeros.append(before)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place``."""
        low = np.zeros_like(place)
        for level, before in zip(range(self.levels - 1, -1, -1), self.zeros, strict=True):
            one, n = ((symbol >> level) & 1).astype(bool), before[-1]
            a, b = before[low], before[place]
            low, place = np.where(one, n + low - a, a), np.where(one, n + place - b, b)
        return place - low

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``place``, and how often it stands before it."""
        symbol, low = np.zeros_like(place), np.zeros_like(place)
        for before in self.zeros:
            n, a, b = before[-1], before[low], before[place]
            one = before[place + 1] == b
            low, place = np.where(one, n + low - a, a), np.where(one, n + place - b, b)
            symbol = 2 * symbol + one
        return symbol, place - low


class FMIndex:
    """Over runs of symbols 1..top, each ended by a zero; no phrase goes across a zero."""

    def __init__(self, seq: np.ndarray, top: int) -> None:
        order = suffix_array(seq)
        self.n = len(seq)
        self.tree = WaveletMatrix(np.where(order > 0, seq[order - 1], 0).astype(np.int64), top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])  # suffixes with a smaller first symbol
        start = np.ones(self.n, bool)
        start[1:] = seq[:-1] == 0
        since = np.arange(self.n) - np.maximum.accumulate(np.where(start, np.arange(self.n), 0))
        self.marked = (since % SAMPLE == 0)[order]
        self.place = np.concatenate([[0], np.cumsum(self.marked)])
        self.sample = order[self.marked]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that start with each phrase (all of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = phrases[live, j].astype(np.int64)
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in ``rows``: steps back to a sampled one."""
        out, at = np.empty(len(rows), np.int64), rows.astype(np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            hit = self.marked[at]
            out[todo[hit]] = self.sample[self.place[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                symbol, rank = self.tree.access(at)
                at, steps = self.before[symbol] + rank, steps + 1
        return out
