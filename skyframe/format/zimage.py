"""Images that are stored as tables of compressed tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..codecs import tiles as codec
from .header import Header
from .status import FitsError

#: ZQUANTIZ by the number of the method.
METHODS = {0: "NO_DITHER", 1: "SUBTRACTIVE_DITHER_1", 2: "SUBTRACTIVE_DITHER_2"}
MOST_AXES = 6


@dataclass
class ZImage:
    """bitpix, axes and tile of the image; method is None where floats are kept whole."""

    bitpix: int
    axes: list[int]
    tile: list[int]
    codec: str = "RICE_1"
    params: dict = field(default_factory=dict)
    method: int | None = None
    seed: int = 1

    @property
    def width(self) -> int:
        return abs(self.bitpix) // 8

    @property
    def across(self) -> list[int]:
        """Tiles along each axis."""
        return [-(-n // t) for n, t in zip(self.axes, self.tile, strict=True)]

    @property
    def rows(self) -> int:
        return math.prod(self.across)

    def place(self, row: int) -> tuple[list[int], list[int]]:
        """(start from 0, size) of a tile along each axis; rows count from 1, the first axis fastest."""
        start, size, rest = [], [], row - 1
        for n, t, k in zip(self.axes, self.tile, self.across, strict=True):
            start.append(rest % k * t)
            size.append(min(t, n - start[-1]))
            rest //= k
        return start, size

    def pixels(self, row: int) -> np.ndarray:
        """Numbers from 1 of a tile's pixels in its order."""
        out, before = np.ones(1, np.int64), 1
        for s, k, n in zip(*self.place(row), self.axes, strict=True):
            out = ((np.arange(s, s + k) * before)[:, None] + out[None, :]).ravel()
            before *= n
        return out

    def rows_of(self, low: int, high: int) -> tuple[int, int]:
        """(first, last) row that pixels from low to high may be in: all rows unless each tile is one run of pixels and all are of a size."""
        k = next((i for i, (n, t) in enumerate(zip(self.axes, self.tile, strict=True)) if t < n), len(self.axes) - 1)
        above = math.prod(self.axes[k + 1 :])
        if math.prod(self.tile[k + 1 :]) != 1 and above != 1 or above != 1 and self.axes[k] % self.tile[k]:
            return 1, self.rows
        per = math.prod(self.axes[:k]) * self.tile[k]
        return max(1, (low - 1) // per + 1), min(self.rows, (high - 1) // per + 1)

    def encode(self, row: int, values: np.ndarray, level: float = 4.0, table: np.ndarray | None = None) -> tuple[bytes | None, bytes | None, float | None, float | None]:
        """(data, data of a tile whose floats stay whole though others are quantised, step, zero)."""
        shape = self.place(row)[1]
        if len(values) != math.prod(shape):
            raise FitsError(308, f"tile {row}")
        scale = int(self.params.get("SCALE", 0))
        if self.bitpix > 0:
            limits = np.iinfo(f"i{self.width}" if self.width > 1 else "u1")
            if values.min() < limits.min or values.max() > limits.max:
                raise FitsError(412)
            return codec.encode_tile(values, self.codec, self.width, shape[0], scale), None, None, None
        raw = values.astype(f">f{self.width}").tobytes()
        if self.method is None:
            return codec.gzip_encode(raw, self.width, self.codec == "GZIP_2"), None, None, None
        got = codec.quantize(values, level, self.method, row + self.seed - 1, table)
        if got is None:
            return None, codec.gzip_encode(raw, self.width), None, None
        return codec.encode_tile(got[0], self.codec, 4, shape[0], scale), None, got[1], got[2]

    def decode(self, row: int, data: bytes, whole: bytes = b"", step: float | None = None, zero: float | None = None, table: np.ndarray | None = None) -> np.ndarray:
        """A tile's pixels as stored in the image."""
        n = math.prod(self.place(row)[1])
        if self.bitpix < 0 and (whole or self.method is None or step is None):
            raw = codec.gzip_decode(whole or data, n, self.width, not whole and self.codec == "GZIP_2")
            return np.frombuffer(raw, f">f{self.width}").astype(f"f{self.width}")
        width = self.width if self.bitpix > 0 else 4
        if self.codec == "RICE_1":
            out = codec.rice_decode(data, n, int(self.params.get("BYTEPIX", 4)), int(self.params.get("BLOCKSIZE", 32)))
        else:
            out = codec.decode_tile(data, n, self.codec, width)[:n]
        if self.bitpix > 0:
            return out.astype(f"i{width}" if width > 1 else "u1")
        return codec.dequantize(out, step, zero, self.method, row + self.seed - 1, table).astype(f"f{self.width}")

    def cards(self) -> list[tuple]:
        """What the header of the table says besides the columns."""
        out = [("ZIMAGE", True, "extension contains compressed image"), ("ZBITPIX", self.bitpix, "data type of original image"), ("ZNAXIS", len(self.axes), "dimension of original image")]
        out += [(f"ZNAXIS{i}", n, "length of original image axis") for i, n in enumerate(self.axes, 1)]
        out += [(f"ZTILE{i}", n, "size of tiles to be compressed") for i, n in enumerate(self.tile, 1)]
        if self.bitpix < 0:
            out.append(("ZQUANTIZ", "NONE" if self.method is None else METHODS[self.method], "quantization of floats"))
            if self.method:
                out.append(("ZDITHER0", self.seed, "dithering offset when quantizing floats"))
        out.append(("ZCMPTYPE", self.codec, "compression algorithm"))
        for i, (name, value) in enumerate(self.params.items(), 1):
            out += [(f"ZNAME{i}", name, None), (f"ZVAL{i}", value, None)]
        return out


def default_tile(name: str, axes: list[int]) -> list[int]:
    """One row of the image; for HCOMPRESS_1 sixteen rows, or all of up to thirty, of four by four pixels at least."""
    if name != "HCOMPRESS_1":
        return [axes[0], *[1] * (len(axes) - 1)]
    if len(axes) < 2:
        raise FitsError(413, "HCOMPRESS_1 takes two axes or more")
    return [axes[0], axes[1] if axes[1] <= 30 else 16, *[1] * (len(axes) - 2)]


def parse(h: Header) -> ZImage | None:
    """Of a table's header, None if it holds no compressed image. As many tiles as rows, at most six axes: else status 414."""
    if h.get("ZIMAGE", False) is not True:
        return None
    n = h.integer("ZNAXIS")
    if not 1 <= n <= MOST_AXES:
        raise FitsError(414, f"{n} axes")
    axes = [h.integer(f"ZNAXIS{i}") for i in range(1, n + 1)]
    tile = [h.get(f"ZTILE{i}", axes[0] if i == 1 else 1) for i in range(1, n + 1)]
    name = h.string("ZCMPTYPE").strip()
    params, i = {}, 1
    while h.has(f"ZNAME{i}"):
        params[h.string(f"ZNAME{i}").strip()] = h.get(f"ZVAL{i}")
        i += 1
    quantised = (h.get("ZQUANTIZ") or "NO_DITHER").strip()
    method = next((k for k, v in METHODS.items() if v == quantised), None)
    z = ZImage(h.integer("ZBITPIX"), axes, tile, "RICE_1" if name == "RICE_ONE" else name, params, method, h.get("ZDITHER0", 1))
    if z.rows != h.integer("NAXIS2"):
        raise FitsError(414, f"{z.rows} tiles in {h.integer('NAXIS2')} rows")
    return z
