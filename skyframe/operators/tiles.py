"""Images as rows of tiles: cutting, joining, compressing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import tiles as codec
from ..format.status import FitsError


def tile_of(pix: Column, axes: list[int], tile: list[int]) -> tuple[Column, Column]:
    """(tile number from 1, the first axis fastest; place in the tile from 0) of a pixel from 1; tiles at the edges are cut off."""
    number, place, rest, tiles_before, cells = F.lit(1).cast("long"), F.lit(0).cast("long"), pix - 1, 1, F.lit(1).cast("long")
    for n, t in zip(axes, tile, strict=True):
        x = rest % n
        rest = F.floor(rest / n)
        k = F.floor(x / t)
        number = number + k * tiles_before
        place = place + (x % t) * cells
        cells = cells * F.least(F.lit(t), F.lit(n) - k * t)
        tiles_before *= -(-n // t)
    return number.cast("long"), place.cast("long")


def gather(df: DataFrame, axes: list[int], tile: list[int], pix: str = "_pix", value: str = "value") -> DataFrame:
    """One row per tile: tile, values in order."""
    number, place = tile_of(F.col(pix), axes, tile)
    rows = df.select(number.alias("tile"), F.struct(place.alias("p"), F.col(value).alias("v")).alias("x"))
    return rows.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("values"))


def scatter(tiles: DataFrame, axes: list[int], tile: list[int], values: str = "values") -> DataFrame:
    """(_pix, value) of rows of tiles, without a shuffle."""
    out = tiles.select(F.col("tile"), F.posexplode(values).alias("_p", "value"))
    rest, place, pix, before = F.col("tile") - 1, F.col("_p").cast("long"), F.lit(1).cast("long"), 1
    for n, t in zip(axes, tile, strict=True):
        across = -(-n // t)
        k = rest % across
        rest = F.floor(rest / across)
        width = F.least(F.lit(t), F.lit(n) - k * t)
        pix = pix + (k * t + place % width) * before
        place = F.floor(place / width)
        before *= n
    return out.select(pix.cast("long").alias("_pix"), "value")


def compress(tiles: DataFrame, name: str, bytepix: int = 4, axes: list[int] | None = None, tile: list[int] | None = None, scale: int = 0) -> DataFrame:
    """(tile, n, data) of (tile, values) by a codec: RICE_1, GZIP_1, GZIP_2, PLIO_1, HCOMPRESS_1, NOCOMPRESS; one tile is a unit of work.
    HCOMPRESS_1 needs the axes of the image and of a tile; a scale above 1 loses detail."""
    if name == "HCOMPRESS_1" and not (axes and tile):
        raise FitsError(413, name)
    width = F.lit(None).cast("long")
    if axes and tile:
        across = -(-axes[0] // tile[0])
        width = F.least(F.lit(tile[0]), F.lit(axes[0]) - F.pmod(F.col("tile") - 1, F.lit(across)) * tile[0]).cast("long")

    @F.pandas_udf("binary")
    def f(s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([codec.encode_tile(np.asarray(v, np.int64), name, bytepix, None if pd.isna(x) else int(x), scale) for v, x in zip(s, w, strict=True)])

    return tiles.select("tile", F.size("values").alias("n"), f("values", width).alias("data"))


def decompress(tiles: DataFrame, name: str, bytepix: int = 4) -> DataFrame:
    @F.pandas_udf("array<long>")
    def f(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([codec.decode_tile(d, int(k), name, bytepix).tolist() for d, k in zip(s, n, strict=True)])

    return tiles.select("tile", f("data", "n").alias("values"))


def quantize(tiles: DataFrame, level: float = 4.0, method: int = 1, seed: int = 1) -> DataFrame:
    """(tile, q, step, zero, whole) of (tile, values): integers, or the floats themselves where integers would not do."""
    table = codec.dither_table()

    @F.pandas_udf("q array<long>, step double, zero double, whole array<double>")
    def f(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for k, v in zip(t, s, strict=True):
            got = codec.quantize(np.asarray(v, float), level, method, int(k) + seed - 1, table)
            out.append((None, None, None, list(v)) if got is None else (got[0].tolist(), got[1], got[2], None))
        return pd.DataFrame(out, columns=["q", "step", "zero", "whole"])

    return tiles.select("tile", f("tile", "values").alias("x")).select("tile", "x.*")


def dequantize(tiles: DataFrame, method: int = 1, seed: int = 1) -> DataFrame:
    table = codec.dither_table()

    @F.pandas_udf("array<double>")
    def f(t: pd.Series, q: pd.Series, step: pd.Series, zero: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([list(w) if a is None else codec.dequantize(np.asarray(a, np.int64), s, z, method, int(k) + seed - 1, table).tolist() for k, a, s, z, w in zip(t, q, step, zero, whole, strict=True)])

    return tiles.select("tile", f("tile", "q", "step", "zero", "whole").alias("values"))
