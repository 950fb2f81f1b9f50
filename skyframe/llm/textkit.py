"""Words, hashes and slices of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: What the words of a text are separated by: the bytes 0x09 to 0x0D and 0x20.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: An odd base, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class Powers:
    """Powers of the base and of its inverse, kept up to the longest use so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, U), np.cumprod(np.full(m - 1, BASE, U))])
                self.down = np.concatenate([np.ones(1, U), np.cumprod(np.full(m - 1, INVERSE, U))])
        return self.up[:n], self.down[:n]


class Prefixes:
    """Polynomial prefix hashes of an array of small numbers: the hash of any slice in constant time."""

    def __init__(self, values: np.ndarray, powers: Powers, seed: int = 0) -> None:
        up, self.down = powers.upto(len(values) + 1)
        term = (values.astype(U) + U(1 + seed)) * up[:-1]
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(term, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def sliding(self, n: int) -> np.ndarray:
        """Of each slice of n elements."""
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def texts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets of rows) for runs of rows of about `most` bytes, or one longer row. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, whole[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the row) of the words; a word never spans two rows."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = True, space
    before[at[:-1]] = True  # a row of no bytes at the end marks the sentinel, which is cut off below
    starts = np.flatnonzero(before[:-1] & ~space)
    after = np.empty(len(raw) + 1, bool)
    after[-1], after[:-1] = True, space
    after[at] = True
    ends = np.flatnonzero(after[1:] & ~space) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, n: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each run of n words of a row; a row of fewer words, but at least one, has one shingle of all of them."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    p = Prefixes(hashes, powers)
    if len(hashes) >= n:
        start = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
        out = mix(p.of(start, start + n) + U(n))
    else:
        start, out = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        start = np.concatenate([start, first[short]])
        out = np.concatenate([out, mix(p.of(first[short], first[short + 1]) + count[short].astype(U))])
    return out, rows[start], start
