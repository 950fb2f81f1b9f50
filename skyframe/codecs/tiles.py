"""Codecs of image tiles: RICE_1, GZIP_1, GZIP_2, PLIO_1, HCOMPRESS_1, and floats as integers with dither."""

from __future__ import annotations

import gzip

import numpy as np

from ..format.status import FitsError
from . import htransform

#: RICE by bytes of a pixel: bits of a block's header, its largest split, bits of a raw value.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}
NULL_VALUE, ZERO_VALUE = -2147483647, -2147483646


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray | int) -> None:
    """Numbers of given widths into an array of bits, the first bit uppermost, from the places `at`."""
    widths = np.broadcast_to(widths, at.shape)
    for j in range(int(widths.max(initial=0))):
        some = widths > j
        bits[at[some] + j] = values[some] >> (widths[some] - 1 - j) & 1


def _get(bits: np.ndarray, at: np.ndarray, widths: np.ndarray | int) -> np.ndarray:
    widths = np.broadcast_to(widths, at.shape)
    out = np.zeros(at.shape, np.int64)
    for j in range(int(widths.max(initial=0))):
        some = widths > j
        out[some] = out[some] << 1 | bits[at[some] + j]
    return out


def rice_encode(pixels: np.ndarray, bytepix: int = 4, block: int = 32) -> bytes:
    """The first pixel, then differences to the pixel before, folded to be positive, in blocks with a common split: the upper part in
    unary, the lower in plain bits. All blocks are coded at once: widths first, then the bits into their places."""
    fsbits, fsmax, raw = RICE[bytepix]
    p = np.asarray(pixels, np.int64)
    n = len(p)
    if not n:
        return b""
    mask = (1 << raw) - 1
    d = np.diff(p, prepend=p[0]) & mask
    d = np.where(d >> (raw - 1), d - (1 << raw), d)
    u = np.where(d >= 0, 2 * d, -2 * d - 1)
    first = np.arange(0, n, block)
    size = np.minimum(block, n - first)
    total = np.add.reduceat(u, first)
    mean = np.maximum((total - size // 2 - 1) / size, 0).astype(np.int64)
    split = np.minimum(np.frexp((mean >> 1).astype(float))[1], fsmax).astype(np.int64)
    none = (split == 0) & (total == 0)
    fs, plain, empty = (np.repeat(x, size) for x in (split, split == fsmax, none))
    top = u >> fs
    widths = np.where(empty, 0, np.where(plain, raw, top + 1 + fs))
    widths[first] += fsbits
    ends = raw + np.cumsum(widths)
    at = ends - widths
    bits = np.zeros(int(ends[-1]), np.uint8)
    _put(bits, np.zeros(1, np.int64), p[:1] & mask, raw)
    _put(bits, at[first], np.where(none, 0, split + 1), fsbits)
    at[first] += fsbits
    _put(bits, at[plain], u[plain], raw)
    coded = ~(plain | empty)
    one, fs = (at + top)[coded], fs[coded]
    bits[one] = 1
    _put(bits, one + 1, u[coded] & ((1 << fs) - 1), fs)
    return np.packbits(bits).tobytes()


def rice_decode(data: bytes, n: int, bytepix: int = 4, block: int = 32) -> np.ndarray:
    """A pass over the codes finds where the unary part of each ends, as codes can't be told apart otherwise; all else is done at once."""
    fsbits, fsmax, raw = RICE[bytepix]
    if not n:
        return np.zeros(0, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    text, end = bits.tobytes(), len(bits)
    if end < raw:
        raise FitsError(414)
    ones, find = [], text.find
    starts = np.zeros(-(-n // block), np.int64)
    split = np.full(len(starts), -1, np.int64)
    at = raw
    for i in range(len(starts)):
        k = min(block, n - i * block)
        if at + fsbits > end:
            raise FitsError(414)
        fs = -1
        for bit in text[at : at + fsbits]:
            fs += (fs + 1) + bit
        at += fsbits
        starts[i], split[i] = at, fs
        if fs == fsmax:
            at += raw * k
        elif fs > fsmax:
            raise FitsError(414)
        elif fs >= 0:
            for _ in range(k):
                one = find(1, at)
                if one < 0:
                    raise FitsError(414)
                ones.append(one)
                at = one + 1 + fs
        if at > end:
            raise FitsError(414)
    size = np.minimum(block, n - block * np.arange(len(starts)))
    fs = np.repeat(split, size)
    u = np.zeros(n, np.int64)
    plain, coded = fs == fsmax, (fs >= 0) & (fs < fsmax)
    inside = np.arange(n) - np.repeat(block * np.arange(len(starts)), size)
    u[plain] = _get(bits, (np.repeat(starts, size) + raw * inside)[plain], raw)
    one, part = np.array(ones, np.int64), fs[coded]
    begin = np.repeat(starts, size)[coded]
    later = np.flatnonzero(inside[coded])
    begin[later] = one[later - 1] + 1 + part[later - 1]
    u[coded] = (one - begin) << part | _get(bits, one + 1, part)
    d = np.where(u & 1, -((u + 1) >> 1), u >> 1)
    p = (int(_get(bits, np.zeros(1, np.int64), raw)[0]) + np.cumsum(d)) & ((1 << raw) - 1)
    return p if bytepix == 1 else np.where(p >> (raw - 1), p - (1 << raw), p)


def gzip_encode(pixels: bytes, width: int, shuffled: bool = False, level: int = 1) -> bytes:
    if shuffled:
        pixels = np.frombuffer(pixels, np.uint8).reshape(-1, width).T.tobytes()
    return gzip.compress(pixels, level, mtime=0)


def gzip_decode(data: bytes, n: int, width: int, shuffled: bool = False) -> bytes:
    out = gzip.decompress(data)
    if len(out) != n * width:
        raise FitsError(414)
    return np.frombuffer(out, np.uint8).reshape(width, n).T.tobytes() if shuffled else out


def plio_encode(pixels: np.ndarray) -> np.ndarray:
    """Words of 16 bits: runs of zeros, runs of one high value, and changes of that value."""
    p = np.asarray(pixels, np.int64)
    if len(p) and (p.min() < 0 or p.max() >= 1 << 24):
        raise FitsError(413)
    first = np.flatnonzero(np.diff(p, prepend=-1))
    out, high, zeros = [], 1, 0
    for value, run in zip(p[first].tolist(), np.diff(first, append=len(p)).tolist(), strict=True):
        if not value:
            zeros = run
            continue
        step = value - high
        while zeros > 4095:
            out.append(4095)
            zeros -= 4095
        if step and abs(step) <= 4095 and not zeros and run == 1:
            out.append((6 if step > 0 else 7) << 12 | abs(step))
            run = 0
        else:
            if step:
                out += [(2 if step > 0 else 3) << 12 | abs(step)] if abs(step) <= 4095 else [1 << 12 | value & 4095, value >> 12]
            if zeros and run == 1 and zeros < 4095:
                out.append(5 << 12 | zeros + 1)
                zeros = run = 0
            if zeros:
                out.append(zeros)
        high, zeros = value, 0
        while run > 0:
            out.append(4 << 12 | min(run, 4095))
            run -= min(run, 4095)
    while zeros > 0:
        out.append(min(zeros, 4095))
        zeros -= min(zeros, 4095)
    total = len(out) + 7
    return np.array([0, 7, -100, total % 32768, total // 32768, 0, 0, *out], np.int32).astype(np.uint16).view(np.int16)


def plio_decode(words: np.ndarray, n: int) -> np.ndarray:
    """Each word is some zeros and then some pixels of the high value that holds after it."""
    w = np.asarray(words, np.int16).view(np.uint16).astype(np.int64)
    total, start = (int(w[3] + w[4] * 32768), int(w[1])) if len(w) >= 7 else (1, 0)
    if total > len(w):
        raise FitsError(414)
    w = w[start:total]
    ones = (w >> 12 == 1).astype(np.int64)
    place = np.arange(len(w))
    chain = place - np.maximum.accumulate(np.where(ones == 0, place, -1)) - 1
    sets = (ones == 1) & (chain % 2 == 0)  # the word behind one that sets the value is the value's upper part
    if len(w) and sets[-1]:
        raise FitsError(414)
    upper = np.flatnonzero(sets) + 1
    value = w & 4095
    value[upper - 1] |= w[upper] << 12
    ops = np.ones(len(w), bool)
    ops[upper] = False
    code, x, sets = w[ops] >> 12, value[ops], sets[ops]
    moved = np.cumsum(np.where((code == 2) | (code == 6), x, np.where((code == 3) | (code >= 7), -x, 0)))
    last = np.maximum.accumulate(np.where(sets, np.arange(len(code)), -1))
    high = moved + np.where(last >= 0, (x - moved)[last], 1) if len(code) else moved
    cells, widths = np.zeros((len(code), 2), np.int64), np.zeros((len(code), 2), np.int64)
    cells[:, 1] = high
    widths[:, 0] = np.select([code == 0, code == 5], [x, np.maximum(x - 1, 0)], 0)
    widths[:, 1] = np.select([code == 4, code == 5, code >= 6], [x, np.minimum(x, 1), 1], 0)
    got = np.repeat(cells.ravel(), widths.ravel())[:n]
    return np.concatenate([got, np.zeros(n - len(got), np.int64)])


def dither_table() -> np.ndarray:
    """10000 numbers in (0, 1) of the generator seed * 16807 mod 2^31 - 1."""
    out, seed = np.empty(10_000, np.float32), 1
    for i in range(10_000):
        seed = seed * 16807 % 2147483647
        out[i] = seed / 2147483647
    return out


def _dither(n: int, row: int, table: np.ndarray) -> np.ndarray:
    """The n numbers of a tile (row from 1): from a place that the row chooses, and at the table's end from another."""
    seed, parts, have = (row - 1) % 10_000, [], 0
    while have < n:
        start = int(np.float32(table[seed]) * np.float32(500))
        parts.append(table[start:])
        have += len(parts[-1])
        seed = (seed + 1) % 10_000
    return np.concatenate(parts)[:n] if parts else table[:0]


def quantize(x: np.ndarray, level: float = 4.0, method: int = 1, row: int = 1, table: np.ndarray | None = None) -> tuple[np.ndarray, float, float] | None:
    """(integers, step, zero) of a row of floats, or None where integers would not do: then it is kept whole. The step is the
    noise / level, or -level if that is negative; noise is 1.482602 times the median step between neighbours. method: 0
    plain, 1 dithered, 2 dithered with zeros exact. NaN becomes NULL_VALUE."""
    x = np.asarray(x, np.float64)
    good = ~np.isnan(x)
    v = x[good]
    if len(v) < 2 or level == 0:
        return None
    noise = 1.482602 * float(np.median(np.abs(np.diff(v))))
    step = noise / level if level > 0 else -level
    if not step > 0 or not np.isfinite(step):
        return None
    low, high = float(v.min()), float(v.max())
    if (high - low) / step > 2.0 * 2147483647 - 20:
        return None
    zero = np.floor(low / step + 0.5) * step if method != 2 else low - step * (NULL_VALUE + 10)
    if (high - zero) / step > 2147483640:
        zero = (low + high) / 2
    q = (x - zero) / step
    if method:
        q = q + (_dither(len(x), row, dither_table() if table is None else table).astype(np.float64) - 0.5)
    q = np.where(good, q, 0)
    q = np.trunc(np.where(q >= 0, q + 0.5, q - 0.5)).astype(np.int64)
    if method == 2:
        q = np.where(x == 0, ZERO_VALUE, q)
    return np.where(good, q, NULL_VALUE), step, float(zero)


def dequantize(q: np.ndarray, step: float, zero: float, method: int = 1, row: int = 1, table: np.ndarray | None = None) -> np.ndarray:
    q = np.asarray(q, np.int64)
    shift = _dither(len(q), row, dither_table() if table is None else table).astype(np.float64) - 0.5 if method else 0.0
    out = (q - shift) * step + zero
    out = np.where(q == NULL_VALUE, np.nan, out)
    return np.where(q == ZERO_VALUE, 0.0, out) if method == 2 else out


def encode_tile(pixels: np.ndarray, codec: str, bytepix: int = 4, width: int | None = None, scale: int = 0) -> bytes:
    """width: pixels in a row of the tile, scale: divisor of coefficients; both for HCOMPRESS_1 alone."""
    big = f">i{bytepix}" if bytepix > 1 else "u1"
    if codec == "RICE_1":
        return rice_encode(pixels, bytepix)
    if codec in ("GZIP_1", "GZIP_2"):
        return gzip_encode(np.asarray(pixels).astype(big).tobytes(), bytepix, codec == "GZIP_2")
    if codec == "PLIO_1":
        return plio_encode(pixels).astype(">i2").tobytes()
    if codec == "HCOMPRESS_1":
        return htransform.encode(np.asarray(pixels).reshape(-1, width or len(pixels)), scale)
    if codec == "NOCOMPRESS":
        return np.asarray(pixels).astype(big).tobytes()
    raise FitsError(413, codec)


def decode_tile(data: bytes, n: int, codec: str, bytepix: int = 4) -> np.ndarray:
    big = f">i{bytepix}" if bytepix > 1 else "u1"
    if codec == "RICE_1":
        return rice_decode(data, n, bytepix)
    if codec in ("GZIP_1", "GZIP_2"):
        return np.frombuffer(gzip_decode(data, n, bytepix, codec == "GZIP_2"), big).astype(np.int64)
    if codec == "PLIO_1":
        return plio_decode(np.frombuffer(data, ">i2").astype(np.int16), n)
    if codec == "HCOMPRESS_1":
        return htransform.decode(data).ravel()
    if codec == "NOCOMPRESS":
        return np.frombuffer(data, big).astype(np.int64)
    raise FitsError(414, codec)
