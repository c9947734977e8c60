"""FM-index over a shard of word numbers: suffix order, wavelet matrix, backward search, sampled positions.

The text of a shard is a sequence of runs of words 1..V, each run closed by the separator 0. Separators sort by position, so
no comparison passes the end of a run and every suffix has one place in the order.
"""

from __future__ import annotations

import numpy as np

#: A run's words at multiples of this offset keep their position in the index; others walk back to one.
SAMPLE = 8


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions of ``text`` (values below 2**bits, 0 a separator, the last value 0) in suffix order.

    The first key packs as many words as fit 60 bits; ties are then resolved by doubling, among themselves only.
    """
    n = len(text)
    width = max(1, 60 // bits)
    key = np.zeros(n, dtype=np.int64)
    closed = np.zeros(n, dtype=bool)  # a separator has been met: what follows does not count
    for k in range(width):
        part = np.zeros(n, dtype=np.int64)
        part[: max(n - k, 0)] = text[k:]
        part[closed] = 0
        key = (key << bits) | part
        closed |= part == 0
    sa = np.argsort(key, kind="stable")  # ties that have met a separator stay in order of position, as they must
    sorted_key, sorted_closed = key[sa], closed[sa]
    starts = np.r_[True, (sorted_key[1:] != sorted_key[:-1]) | sorted_closed[1:]]
    rank = np.empty(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[sa] = first
    reach = width
    while True:
        alone = starts & np.r_[starts[1:], True]
        open_ = np.flatnonzero(~alone)
        if len(open_) == 0:
            return sa
        at = sa[open_]
        group, nxt = rank[at], rank[at + reach]
        order = np.lexsort((nxt, group))
        at, group, nxt = at[order], group[order], nxt[order]
        sa[open_] = at
        fresh = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        starts[open_] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
        reach *= 2


class WaveletMatrix:
    """Ranks of a symbol in a prefix of a sequence, for many (symbol, prefix) at a time."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        now = symbols
        for b in range(bits - 1, -1, -1):
            ones = ((now >> b) & 1).astype(bool)
            self.levels.append(np.r_[0, np.cumsum(ones, dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(now) - self.levels[-1][-1]))
            now = np.r_[now[~ones], now[ones]]

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences before ``lo`` and before ``hi``, both counted from the start of the symbol's block of the last level."""
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return lo, hi


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        """``text``: runs of 1..top closed by 0; not empty."""
        self.n = len(text)
        bits = max(1, int(top).bit_length())
        sa = suffix_order(text, bits)
        before = np.r_[text[-1:], text[:-1]]  # the word in front of each position; at a run's start the separator
        self.last = before[sa]
        self.wavelet = WaveletMatrix(self.last, bits)
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.r_[0, np.cumsum(counts)]  # rows whose suffix starts with a smaller word
        everything = np.arange(top + 1)
        self.block = self.wavelet.rank(everything, np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64))[0]
        separators = np.flatnonzero(text == 0)
        run_start = np.r_[0, separators[:-1] + 1]
        offset = np.arange(self.n) - np.repeat(run_start, np.diff(np.r_[run_start, self.n]))
        sampled = offset[sa] % SAMPLE == 0
        self.sampled = np.r_[0, np.cumsum(sampled)]
        self.positions = sa[sampled]

    def _step(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.wavelet.rank(word, lo, hi)
        shift = self.first[word] - self.block[word]
        return lo + shift, hi + shift

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (rows of words, right-aligned in the matrix), by backward search."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if len(live):
                lo[live], hi[live] = self._step(patterns[live, width - 1 - k], lo[live], hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled row, add the steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.arange(len(rows))
        while True:
            known = self.sampled[rows[walking] + 1] > self.sampled[rows[walking]]
            walking = walking[~known]
            if len(walking) == 0:
                return self.positions[self.sampled[rows]] + steps
            at = rows[walking]
            rows[walking] = self._step(self.last[at], at, at)[0]
            steps[walking] += 1
