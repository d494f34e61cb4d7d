"""A compressed FM-index over sequences of integers, searched for many patterns at once with NumPy.

The Burrows-Wheeler transform is kept as a wavelet matrix of packed bits (one bit a level and symbol, and a count a
word). Suffixes are sorted by their first `depth` symbols only: intervals of patterns up to that length are exact, and
long repeats cost nothing extra. Symbol 0 ends each sequence and matches nothing.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        x = symbols
        base, codes = np.zeros(top + 1, np.int64), np.arange(top + 1)
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = ((x >> level) & 1).astype(bool)
            packed = np.zeros(-(-(len(x) + 1) // 64) * 8, np.uint8)
            packed[: -(-len(x) // 8)] = np.packbits(bit, bitorder="little")
            word = packed.view(U)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(word))[:-1])).astype(np.int32)
            zeros = int(len(x) - bit.sum())
            self.levels.append((level, word, before, zeros))
            base = self._step(self.levels[-1], base, codes)
            x = np.concatenate((x[~bit], x[bit]))
        self.base = base

    @staticmethod
    def _step(level: tuple, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        shift, word, before, zeros = level
        block = at >> 6
        ones = before[block] + np.bitwise_count(word[block] & ((U(1) << (at & 63).astype(U)) - U(1)))
        return np.where((symbol >> shift) & 1, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for level in self.levels:
            at = self._step(level, at, symbol)
        return at - self.base[symbol]


class FMIndex:
    """text: symbols 1..top, 0 after each sequence. values: a number for each place of the text, of which intervals know the least."""

    def __init__(self, text: np.ndarray, depth: int, values: np.ndarray | None = None):
        n = self.n = len(text)
        self.depth = depth
        ranks, h = [text.astype(np.int64)], 1
        while h < depth:
            r = ranks[-1]
            after = np.zeros(n, np.int64)
            after[: n - h] = r[h:] + 1 if n > h else 0
            ranks.append(np.unique(r * (int(r.max()) + 2) + after, return_inverse=True)[1])
            h *= 2
        suffixes = np.argsort(ranks[-1], kind="stable")
        # symbols that neighbours in suffix order have in common, at most depth
        a, b = suffixes[:-1], suffixes[1:]
        common = np.zeros(len(a), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + common, b + common
            ok = (x < n) & (y < n)
            ok &= ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)]
            common += ok << k
        self.lcp = np.zeros(n + 1, np.uint8 if depth < 256 else np.uint16 if depth < 1 << 16 else np.int64)
        self.lcp[1:n] = np.minimum(common, depth)
        top = int(text.max()) if n else 0
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.top = top
        self.bwt = WaveletMatrix(text[suffixes - 1], top)
        # of each set of suffixes that share `depth` symbols the least value; the suffixes themselves are not kept
        self.edge, _, of = self.groups(depth)
        self.of = of.astype(np.int32)
        self.least = None if values is None else np.minimum.reduceat(values[suffixes], self.edge) if n else np.zeros(0, np.int64)
        self._mins: list[np.ndarray] = []

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a symbol put before them."""
        start = self.first[symbol]
        both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return start + both[: len(lo)], start + both[len(lo) :]

    def groups(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the sets of suffixes that share `length` symbols: start, end, and the number of each suffix's set."""
        edge = np.flatnonzero(self.lcp[: self.n] < length)
        return edge, np.append(edge[1:], self.n), np.cumsum(self.lcp[: self.n] < length) - 1

    def shrink(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parent intervals: those of the longest beginnings that more suffixes share."""
        if not self._mins:
            self._mins = [self.lcp]
            while (1 << len(self._mins)) <= self.n:
                m, k = self._mins[-1], 1 << (len(self._mins) - 1)
                self._mins.append(np.minimum(m[:-k], m[k:]))
        length = np.maximum(self.lcp[lo], self.lcp[hi])
        lo, hi = lo.copy(), hi.copy()
        for k in range(len(self._mins) - 1, -1, -1):
            m, w = self._mins[k], 1 << k
            ok = lo - w + 1 >= 0
            ok &= m[np.maximum(lo - w + 1, 0)] >= length
            lo -= np.where(ok, w, 0)
            ok = hi + w <= len(self.lcp)
            ok &= m[np.minimum(hi, len(m) - 1)] >= length
            hi += np.where(ok, w, 0)
        return lo, hi, length.astype(np.int64)

    def statistics(self, patterns: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the streams patterns[starts[i]:ends[i]]: for each place the length, at most `most`
        (below depth), of the longest match that begins there, and the start of that match's interval. Symbols
        that the index has not are given as 0. All streams advance together, from their ends."""
        size, found = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        low, high, of = self.groups(most - 1)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, ends = starts[order], ends[order]
        lo, hi, length = np.zeros(len(starts), np.int64), np.full(len(starts), self.n), np.zeros(len(starts), np.int64)
        longest = int((ends - starts).max()) if len(starts) else 0
        counts = ends - starts
        for step in range(1, longest + 1):
            live = int(np.searchsorted(-counts, -step, "right"))
            at = ends[:live] - step
            todo = np.arange(live)
            symbol = patterns[at]
            none = symbol == 0
            lo[:live][none], hi[:live][none], length[:live][none] = 0, self.n, 0
            todo = todo[~none]
            while len(todo):
                a, b = self.extend(lo[todo], hi[todo], symbol[todo])
                ok = a < b
                done = todo[ok]
                lo[done], hi[done] = a[ok], b[ok]
                length[done] += 1
                todo = todo[~ok]
                if len(todo):
                    todo = todo[length[todo] > 0]
                    lo[todo], hi[todo], length[todo] = self.shrink(lo[todo], hi[todo])
            size[at], found[at] = length[:live], lo[:live]
            full = np.flatnonzero(length[:live] >= most)  # patterns stay below the depth
            g = of[lo[full]]
            lo[full], hi[full], length[full] = low[g], high[g], most - 1
        return size, found
