"""A compressed FM-index over a sequence of integer symbols, in numpy.

The Burrows-Wheeler transform is held as a wavelet matrix of packed bits with block ranks.  Suffixes
are ordered by their first 2**j >= depth symbols, which is all that patterns of up to ``depth``
symbols need: their intervals are contiguous and backward steps between them are exact.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        order = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((order >> np.uint32(level)) & np.uint32(1)).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, np.uint8)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.ranks.append(np.append(0, np.cumsum(np.bitwise_count(packed)[:-1], dtype=np.int32)).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum(dtype=np.int64)))
            order = np.concatenate([order[bit == 0], order[bit == 1]])
        every = np.arange(alphabet, dtype=np.uint32)
        self.begin = self._walk(every, np.zeros(alphabet, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, ranks, zeros in zip(range(self.levels - 1, -1, -1), self.words, self.ranks, self.zeros, strict=True):
            block = at >> 6
            below = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = ranks[block] + np.bitwise_count(below)
            at = np.where((symbols >> np.uint32(level)) & np.uint32(1), zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbols, at) - self.begin[symbols]


class FMIndex:
    """Index of ``text`` (symbols 0..alphabet-1; 0 parts the documents) for patterns of ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.n, self.depth, self.alphabet = n, depth, int(text.max()) + 1
        ranks = {1: text.astype(np.int64)}
        k = 1
        while k < depth:
            r = ranks[k]
            ahead = np.concatenate([r[k:], np.full(min(k, n), -1, np.int64)])[:n] + 1
            ranks[2 * k] = np.unique(r * (r.max() + 2) + ahead, return_inverse=True)[1]
            k *= 2
        self.order = np.argsort(ranks[k], kind="stable")
        bwt = text[self.order - 1]
        self.wavelet = WaveletMatrix(bwt, self.alphabet)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=self.alphabet)))
        #: intervals of the prefixes of depth and depth - 1 symbols: number by row, and bounds
        self.full, self.full_at = self._groups(ranks, depth)
        self.short, self.short_at = self._groups(ranks, depth - 1)

    def _groups(self, ranks: dict[int, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
        if length == 0:
            return np.zeros(self.n, np.int64), np.array([0, self.n])
        p = 1 << (length.bit_length() - 1)
        r = ranks[p]
        a = r[self.order]
        b = np.append(r, np.full(length, -1))[self.order + length - p]
        new = np.ones(self.n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.cumsum(new) - 1, np.append(np.flatnonzero(new), self.n)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with symbols put in front (backward search)."""
        start = self.before[symbols]
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        return start + both[: len(lo)], start + both[len(lo) :]

    def drop_last(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of full patterns less their last symbol."""
        g = self.short[lo]
        return self.short_at[g], self.short_at[g + 1]

    def _shortened(self, symbols: np.ndarray, at: np.ndarray, most: np.ndarray):
        """The longest match of at most ``most`` symbols from each position on: (lo, hi, length)."""
        lo, hi, length = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        for size in range(int(most.max()), 0, -1):
            own = open_[most[open_] >= size]
            a, b = np.zeros(len(own), np.int64), np.full(len(own), self.n, np.int64)
            for j in range(size - 1, -1, -1):
                a, b = self.extend(symbols[at[own] + j].astype(np.uint32), a, b)
                b = np.maximum(a, b)
            hit = own[b > a]
            lo[hit], hi[hit], length[hit] = a[b > a], b[b > a], size
            open_ = open_[length[open_] == 0]
        return lo, hi, length

    def matching(self, symbols: np.ndarray, first: np.ndarray, count: np.ndarray):
        """Matching statistics of streamed sequences, cut off at depth: yields (starts, rows, lo, hi)
        for the positions whose longest match reaches depth.

        symbols holds the sequences; sequence i is symbols[first[i]: first[i] + count[i]].  A match that
        can't be extended is shortened at its end until it can.
        """
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), self.n, np.int64)
        length = np.zeros(len(first), np.int64)
        for t in range(int(count[0]) if len(count) else 0):
            n = int(np.searchsorted(-count, -t, "left"))  # those with count > t come first
            lo, hi, length = lo[:n], hi[:n], length[:n]
            at = first[:n] + count[:n] - 1 - t
            cut = length == self.depth
            if cut.any():
                lo[cut], hi[cut] = self.drop_last(lo[cut])
                length[cut] -= 1
            new_lo, new_hi = self.extend(symbols[at].astype(np.uint32), lo, hi)
            broken = np.flatnonzero(new_lo >= new_hi)
            lo, hi, length = new_lo, new_hi, length + 1
            if len(broken):
                lo[broken], hi[broken], length[broken] = self._shortened(symbols, at[broken], length[broken] - 1)
            full = np.flatnonzero(length == self.depth)
            if len(full):
                yield at[full], order[full], lo[full], hi[full]
