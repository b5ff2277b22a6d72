"""An FM-index over a sequence of symbols, in numpy.

Symbol 0 separates: no pattern holds it, and the zeros of a sequence count as
different symbols, ordered by position.  So suffixes are compared no further than
the next zero, and a walk back through the text ends at the last sample before it.
All searches run on many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of ``text`` (which ends with 0); the zeros come first, in order."""
    n = len(text)
    zeros, starts = np.flatnonzero(text == 0), np.flatnonzero(text)
    z = len(zeros)
    if not len(starts):
        return zeros
    width, place = int(text.max()).bit_length(), n.bit_length()
    depth = max(1, min(8, (63 - place) // width))
    key = np.zeros(len(starts), np.int64)
    alive = np.ones(len(starts), bool)
    for j in range(depth):  # what follows a zero doesn't count
        symbol = np.where(alive, text[np.minimum(starts + j, n - 1)], 0)
        alive &= symbol != 0
        key = (key << width) | symbol
    key = np.sort((key << place) | starts)
    sa = key & ((1 << place) - 1)
    key >>= place
    fresh = np.ones(len(sa), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (key[1:] & ((1 << width) - 1) == 0)
    rank = np.empty(n, np.int64)
    rank[zeros] = np.arange(z)
    rows = np.arange(len(sa))
    group = np.maximum.accumulate(np.where(fresh, rows, 0))
    rank[sa] = z + group
    while True:
        tied = ~fresh
        tied[:-1] |= tied[1:]  # the first of a group, too
        rows, group = rows[tied], group[tied]
        if not len(rows):
            return np.concatenate([zeros, sa])
        at = sa[rows]
        pair = group * (n + 1) + rank[at + depth]
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        sa[rows] = at
        fresh = np.ones(len(rows), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        group = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        rank[at] = z + group
        depth *= 2


class Wavelet:
    """A wavelet matrix: counts of any symbol in any prefix, for arrays of queries."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(sequence) - int(ones[-1]))
            set_ = bit.astype(bool)
            sequence = np.concatenate([sequence[~set_], sequence[set_]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """For each array of prefix ends, how often the symbols occur before them."""
        places = [np.zeros(len(symbol), np.int64), *ends]
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            for k, p in enumerate(places):
                o = ones[p]
                places[k] = np.where(bit, zeros + o, p - o)
        return [p - places[0] for p in places[1:]]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some places and how often each occurs before its place."""
        symbol, low = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            o, l = ones[place], ones[low]
            bit = ones[place + 1] > o
            symbol = (symbol << 1) | bit
            place, low = np.where(bit, zeros + o, place - o), np.where(bit, zeros + l, low - l)
        return symbol, place - low


class FMIndex:
    def __init__(self, text: np.ndarray, top: int, every: int = 16):
        """``text``: symbols up to ``top``, the last of them 0.  ``every``: distance of sampled positions."""
        order = suffix_order(text)
        before = text[order - 1]
        self.wavelet = Wavelet(before, top)
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.first[1:])
        sampled = (order % every == 0) | (before == 0)
        self.samples = order[sampled]
        self.sampled = np.zeros(len(text) + 1, np.int32)
        np.cumsum(sampled, out=self.sampled[1:])
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (a row of symbols, padded behind its length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step]
            a, b = self.wavelet.rank(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a, self.first[symbol] + b
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: back to the next sampled position, counting the steps."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            s = self.sampled[rows]
            found = self.sampled[rows + 1] > s
            out[left[found]] = self.samples[s[found]] + steps
            left, rows = left[~found], rows[~found]
            symbol, before = self.wavelet.access(rows)
            rows = self.first[symbol] + before
            steps += 1
        return out
