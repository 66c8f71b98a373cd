"""An FM-index over a sequence of integers: wavelet matrix of its Burrows-Wheeler transform, counts, and sampled suffix positions.

Searches take many patterns at once; every step is a numpy operation over all of them.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s in their order, by doubling the compared length and re-ranking."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    length = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(n - length, 0)] = rank[length:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both)
        ordered = both[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        length *= 2


class WaveletMatrix:
    """rank(c, i): how often c occurs among the first i symbols."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (s >> bit) & 1
            upto = np.zeros(len(s) + 1, dtype=np.int32)
            np.cumsum(ones, out=upto[1:])
            zeros = len(s) - int(upto[-1])
            self.levels.append((bit, upto, zeros))
            s = np.concatenate([s[ones == 0], s[ones == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros(len(c), dtype=np.int64), i
        for bit, upto, zeros in self.levels:
            one = (c >> bit) & 1 == 1
            start = np.where(one, zeros + upto[start], start - upto[start])
            end = np.where(one, zeros + upto[end], end - upto[end])
        return end - start


class FMIndex:
    """Index of symbols from 1 up; 0 is the end mark it adds itself."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        s = np.append(np.asarray(symbols, dtype=np.int64), 0)
        sa = suffix_array(s)
        self.n = len(s)
        self.bwt = s[sa - 1]
        top = int(s.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        self.tree = WaveletMatrix(self.bwt, max(1, top.bit_length()))
        kept = sa % sample == 0
        self.kept, self.number = kept, np.cumsum(kept) - 1
        self.positions = sa[kept]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        known = c < len(self.before) - 1
        c = np.where(known, c, 0)
        return np.where(known, self.before[c] + self.tree.rank(c, i), 0)

    def ranges(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the rows [from, to) of the suffixes that begin with it."""
        size = np.array([len(p) for p in patterns], dtype=np.int64)
        padded = np.zeros((len(patterns), int(size.max(initial=0))), dtype=np.int64)
        for k, p in enumerate(patterns):
            padded[k, padded.shape[1] - len(p) :] = p
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for back in range(1, padded.shape[1] + 1):
            at = np.flatnonzero((size >= back) & (lo < hi))
            c = padded[at, -back]
            lo[at], hi[at] = self.step(c, lo[at]), self.step(c, hi[at])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one, and count the steps."""
        rows = rows.copy()
        out = np.zeros(len(rows), dtype=np.int64)
        at, walked = np.arange(len(rows)), 0
        while len(at):
            here = self.kept[rows[at]]
            out[at[here]] = self.positions[self.number[rows[at[here]]]] + walked
            at = at[~here]
            rows[at] = self.step(self.bwt[rows[at]], rows[at])
            walked += 1
        return out

    def occurrences(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, position) of every occurrence of every pattern."""
        lo, hi = self.ranges(patterns)
        count = hi - lo
        which = np.repeat(np.arange(len(patterns)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return which, self.locate(rows)
