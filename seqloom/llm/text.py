"""NumPy kernels over blocks of texts: words, hashes of words and of word windows.

A block is the UTF-8 bytes of several texts, one after the other, and their offsets. A word is a maximal run of
bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as for code points. Hashes are 64-bit: polynomial in
the bytes, then mixed, so that equal words have equal hashes everywhere and different ones collide with a chance of
about n^2 / 2^65 among n different words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(U)
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, U)
        out[:1] = 1
        return np.multiply.accumulate(out)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `most` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a block."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.flatnonzero(ink & (edge[:n] | ~np.concatenate(([False], ink[:-1]))))
    end = np.flatnonzero(ink & (edge[1:] | ~np.concatenate((ink[1:], [False])))) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    out = np.empty(len(start), U)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            first = start[at]
            to = max(at + 1, int(np.searchsorted(end, first + chunk, "right")))
            part = data[first : end[to - 1]]
            if len(_POWERS[0]) < len(part) + 1:
                _POWERS[:] = powers(BASE, len(part) + chunk), powers(INVERSE, len(part) + chunk)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(BYTE[part] * _POWERS[0][: len(part)], out=total[1:])
            s, e = start[at:to] - first, end[at:to] - first
            out[at:to] = mix((total[e] - total[s]) * _POWERS[1][s] + (e - s).astype(U))
            at = to
    return out


_POWERS = [np.zeros(0, U), np.zeros(0, U)]


def windows(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of k words of one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    first = np.flatnonzero(row[k - 1 :] == row[:n])
    with np.errstate(over="ignore"):
        if k <= 10:
            total = np.zeros(n, U)
            for j in range(k):
                total = total * U(BASE) + h[j : j + n]
        else:
            total = np.zeros(len(h) + 1, U)
            np.cumsum(h * powers(BASE, len(h)), out=total[1:])
            total = (total[k:] - total[:n]) * powers(INVERSE, n)
        return first, mix(total[first])


def covered(n: int, first: np.ndarray, k: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of `first`."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, first, 1)
    np.add.at(d, np.minimum(first + k, n), -1)
    return np.cumsum(d[:n]) > 0


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
