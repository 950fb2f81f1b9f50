"""HCOMPRESS_1: images as Haar-like coefficients whose bit planes are quadtrees (White, Postman and Lattanzi, 1992)."""

from __future__ import annotations

import struct

import numpy as np

from ..format.status import FitsError

MAGIC = b"\xdd\x99"
#: Fixed values of the format: (code, bits) of the nybbles 0 to 15.
CODES = ((0x3E, 6), (0x00, 3), (0x01, 3), (0x08, 4), (0x02, 3), (0x09, 4), (0x1A, 5), (0x1B, 5), (0x03, 3), (0x1C, 5), (0x0A, 4), (0x1D, 5), (0x0B, 4), (0x1E, 5), (0x3F, 6), (0x0C, 4))
CODE, WIDTH = np.array(CODES).T


def _levels(*axes: int) -> int:
    return (max(*axes, 1) - 1).bit_length()


def _views(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four corners of the whole 2x2 cells of a; then the pairs along a last odd column, along a last odd row, and the last odd corner."""
    x, y = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    return a[:x:2, :y:2], a[:x:2, 1:y:2], a[1:x:2, :y:2], a[1:x:2, 1:y:2], a[:x:2, y:], a[1:x:2, y:], a[x:, :y:2], a[x:, 1:y:2], a[x:, y:]


def _parted(n: int) -> np.ndarray:
    """Even places, then odd ones."""
    return np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2)])


def transform(image: np.ndarray) -> np.ndarray:
    """Coefficients of a 2-D image, the least detailed first along both axes."""
    out = np.array(image, np.int64)
    x, y = out.shape
    for level in range(_levels(x, y)):
        a = out[:x, :y]
        shift, unit = min(level, 1), 1 << level
        diff = lambda v: np.where(v >= 0, v + unit, v) & (-2 * unit)  # noqa: E731, B023
        total = lambda v: np.where(v >= 0, v + 2 * unit, v + 2 * unit - 1) & (-4 * unit)  # noqa: E731, B023
        p, q, r, s, c0, c1, r0, r1, corner = _views(a)
        h, hx, hy, hc = (v >> shift for v in (p + q + r + s, r + s - p - q, q + s - p - r, p + s - q - r))
        p[:], q[:], r[:], s[:] = total(h), diff(hy), diff(hx), hc
        up = 1 - shift
        for u, v in ((c0, c1), (r0, r1)):
            u[:], v[:] = total((u + v) << up), diff((v - u) << up)
        corner[:] = total(corner << (2 - shift))
        out[:x, :y] = a[_parted(x)][:, _parted(y)]
        x, y = (x + 1) // 2, (y + 1) // 2
    return out


def restore(coefficients: np.ndarray) -> np.ndarray:
    """The image of coefficients; exact if they were not scaled."""
    out = np.array(coefficients, np.int64)
    if not out.size:
        return out
    levels = _levels(*out.shape)
    if not levels:
        # a single pixel has been through no pass
        return out
    near = lambda v, unit, less=1: (v + np.where(v >= 0, unit >> 1, (unit >> 1) - less)) & -unit
    out[0, 0] = near(out[0, 0], 2 << levels)
    for level in range(levels - 1, -1, -1):
        x, y = (-(-n >> level) for n in out.shape)
        back = out[:x, :y].copy()
        a = np.empty_like(back)
        a[np.ix_(_parted(x), _parted(y))] = back
        one, two, shift = 1 << level, 2 << level, 1 if level else 2
        p, q, r, s, c0, c1, r0, r1, corner = _views(a)
        hx, hy, hc = near(r, two), near(q, two), near(s, one, 1 if level else 0)
        low = hc & one
        hx, hy = (np.where(v >= 0, v - low, v + low) for v in (hx, hy))
        high = (hc ^ hx ^ hy) & two
        h = np.where(p >= 0, p + low - high, p + np.where(low == 0, high, low - high))
        p[:], q[:], r[:], s[:] = (v >> shift for v in (h - hx - hy + hc, h - hx + hy - hc, h + hx - hy - hc, h + hx + hy + hc))
        for u, v in ((c0, c1), (r0, r1)):
            d = near(v, two)
            high = d & two
            h = np.where(u >= 0, u - high, u + high)
            u[:], v[:] = (h - d) >> shift, (h + d) >> shift
        corner[:] = corner >> shift
        out[:x, :y] = a
    return out


def _nybbles(bits: np.ndarray) -> np.ndarray:
    """Of each 2x2 cell of a 0/1 array, the upper left bit uppermost; cells at the edge are filled up with 0."""
    (x, y), b = bits.shape, bits
    if x % 2 or y % 2:
        b = np.zeros((x + x % 2, y + y % 2), bits.dtype)
        b[:x, :y] = bits
    return b[::2, ::2] << 3 | b[::2, 1::2] << 2 | b[1::2, ::2] << 1 | b[1::2, 1::2]


def _cells(nybbles: np.ndarray, x: int, y: int) -> np.ndarray:
    out = np.empty((2 * nybbles.shape[0], 2 * nybbles.shape[1]), np.int64)
    out[::2, ::2], out[::2, 1::2], out[1::2, ::2], out[1::2, 1::2] = (nybbles >> k & 1 for k in (3, 2, 1, 0))
    return out[:x, :y]


def _quadrants(a: np.ndarray) -> list[np.ndarray]:
    x, y = (a.shape[0] + 1) // 2, (a.shape[1] + 1) // 2
    return [a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]]


def _plane(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, widths) of a bit plane of a quadrant: its quadtree from the root, or its nybbles where the tree is no shorter."""
    leaf = _nybbles(bits)
    levels, at = [leaf], leaf
    for _ in range(1, _levels(*bits.shape)):
        at = _nybbles((at != 0).astype(np.int64))
        levels.append(at)
    tree = np.concatenate([v.ravel() for v in levels])
    tree = tree[tree != 0][::-1]
    if len(tree) and WIDTH[tree].sum() // 8 >= (leaf.size + 1) // 2:
        return np.concatenate([[0], leaf.ravel()]), np.full(leaf.size + 1, 4)
    if not len(tree):
        tree = np.zeros(1, np.int64)
    return np.concatenate([[15], CODE[tree]]), np.concatenate([[4], WIDTH[tree]])


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    which = np.repeat(np.arange(len(widths)), widths)
    return np.packbits((codes[which] >> (ends[which] - 1 - np.arange(ends[-1])) & 1).astype(np.uint8)).tobytes()


def encode(image: np.ndarray, scale: int = 0) -> bytes:
    """A 2-D image of integers, its first axis the slow one. scale above 1 divides coefficients and loses detail."""
    a = transform(image)
    if scale > 1:
        d = (scale + 1) // 2 - 1
        a = np.sign(a) * ((np.abs(a) + d) // scale)
    total = int(a[0, 0])
    a[0, 0] = 0
    flat = a.ravel()
    signs = np.packbits(flat[flat != 0] < 0).tobytes()
    quads = _quadrants(np.abs(a))
    most = [int(q.max(initial=0)).bit_length() for q in quads]
    planes = [most[0], max(most[1], most[2]), most[3]]
    parts = [_plane((q >> b) & 1) for q, n in zip(quads, (planes[0], planes[1], planes[1], planes[2]), strict=True) for b in range(n - 1, -1, -1)]
    parts.append((np.zeros(1, np.int64), np.full(1, 4)))
    stream = _packed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return MAGIC + struct.pack(">iiiq3B", *a.shape, scale, total, *planes) + stream + signs


class _Bits:
    """Reads numbers from the front of bytes."""

    def __init__(self, data: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
        # the nybble that the next six bits begin with, and the bits it takes
        self.next = {code << (6 - w) | k: (n, w) for n, (code, w) in enumerate(CODES) for k in range(1 << (6 - w))}
        padded = np.concatenate([self.bits, np.zeros(6, np.uint8)]).astype(np.int64)
        self.six = sum(padded[k : k + len(self.bits)] << (5 - k) for k in range(6)).tolist()

    def nybbles(self, n: int) -> np.ndarray:
        got = self.bits[self.at : self.at + 4 * n].reshape(-1, 4) if self.at + 4 * n <= len(self.bits) else None
        if got is None:
            raise FitsError(414)
        self.at += 4 * n
        return got @ np.array([8, 4, 2, 1])

    def symbols(self, n: int) -> list[int]:
        out, at = [], self.at
        for _ in range(n):
            if at >= len(self.six):
                raise FitsError(414)
            symbol, width = self.next[self.six[at]]
            out.append(symbol)
            at += width
        self.at = at
        return out


def _read_plane(bits: _Bits, x: int, y: int) -> np.ndarray:
    kind = int(bits.nybbles(1)[0])
    sizes = [((x + 1) // 2, (y + 1) // 2)]
    for _ in range(1, _levels(x, y)):
        sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
    if kind == 0:
        return _cells(bits.nybbles(sizes[0][0] * sizes[0][1]).reshape(sizes[0]), x, y)
    if kind != 15:
        raise FitsError(414)
    if not x * y:
        bits.symbols(1)
        return np.zeros((x, y), np.int64)
    at = np.array(bits.symbols(1)).reshape(1, 1)
    for size in sizes[-2::-1]:
        at = _cells(at, *size)
        full = np.argwhere(at)[::-1]
        at[full[:, 0], full[:, 1]] = bits.symbols(len(full))
    return _cells(at, x, y)


def decode(data: bytes) -> np.ndarray:
    if len(data) < 25 or data[:2] != MAGIC:
        raise FitsError(414)
    nx, ny, scale, total, *planes = struct.unpack(">iiiq3B", data[2:25])
    a = np.zeros((nx, ny), np.int64)
    bits = _Bits(data[25:])
    for quad, n in zip(_quadrants(a), (planes[0], planes[1], planes[1], planes[2]), strict=True):
        for b in range(n - 1, -1, -1):
            quad |= _read_plane(bits, *quad.shape) << b
    if bits.nybbles(1)[0]:
        raise FitsError(414)
    start = -(-bits.at // 8) * 8
    full = np.flatnonzero(a)
    negative = bits.bits[start : start + len(full)]
    if len(negative) < len(full):
        raise FitsError(414)
    flat = a.ravel()
    flat[full] = np.where(negative, -flat[full], flat[full])
    flat[0] = total
    return restore(a * scale if scale > 1 else a)
