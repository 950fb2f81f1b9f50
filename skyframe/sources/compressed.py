"""Images written as tables of compressed tiles; read_fits() reads them like other images."""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import tiles as codec
from ..format import tables as tb
from ..format import zimage
from ..format.status import FitsError
from ..functions import checksum as sums
from ..operators.tiles import gather, tile_of
from . import files
from .fits import IMAGE_TYPES, _place, _scan, read_fits, write_fits

#: Columns of a compressed image's table: what each holds of a tile.
HOLDS = {"COMPRESSED_DATA": "data", "GZIP_COMPRESSED_DATA": "whole", "ZSCALE": "step", "ZZERO": "zero"}


def _stored(value: str, bitpix: int, zero: int) -> Column:
    x = F.col(value).cast("double")
    return x if bitpix < 0 else (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long") - zero


def write_compressed_image(
    df: DataFrame, path: str, axes: list[int], kind: str, name: str = "RICE_1", *, tile: list[int] | None = None, level: float = 4.0, method: int = 1, seed: int = 1,
    scale: int = 0, smooth: int = 0, value: str = "value", pix: str = "_pix", checksum: bool = False,
) -> None:
    """One compressed image from all its pixels (_pix from 1, value), a tile being a unit of work. kind: a name of IMAGE_TYPES up to 32 bits.

    Floats become integers of a step of noise / level, or of -level; method is 0 (plain), 1 or 2 (dithered); level 0 keeps them
    whole, which takes GZIP_1 or GZIP_2. Tiles that integers would not do for are kept whole. Null is NaN in floats, status 314
    in integers. A pixel that lacks or stands twice: status 308. scale, smooth: of HCOMPRESS_1.
    """
    if kind in ("i64", "u64"):
        raise FitsError(410, kind)
    bitpix, zero = IMAGE_TYPES[kind]
    whole = bitpix < 0 and not level
    if whole and name not in ("GZIP_1", "GZIP_2"):
        raise FitsError(413, "floats are kept whole by GZIP alone")
    if name == "HCOMPRESS_1":
        method = min(method, 1)
    params = {"RICE_1": {"BLOCKSIZE": 32, "BYTEPIX": min(abs(bitpix) // 8, 4) if bitpix > 0 else 4}, "HCOMPRESS_1": {"SCALE": scale, "SMOOTH": smooth}}.get(name, {})
    z = zimage.ZImage(bitpix, axes, tile or zimage.default_tile(name, axes), name, params, None if whole or bitpix > 0 else method, seed)
    table = codec.dither_table() if bitpix < 0 and method else None

    @F.pandas_udf("data binary, whole binary, step double, zero double")
    def f(rows: pd.Series, tiles: pd.Series) -> pd.DataFrame:
        out = []
        for row, v in zip(rows, tiles, strict=True):
            if bitpix > 0 and any(x is None or x != x for x in v):
                raise FitsError(314)
            out.append(z.encode(int(row), np.asarray(v, np.int64 if bitpix > 0 else np.float64), level, table))
        return pd.DataFrame(out, columns=["data", "whole", "step", "zero"])

    cut = gather(df.select(F.col(pix).cast("long").alias("_pix"), _stored(value, bitpix, zero).alias("value")), axes, z.tile)
    rows = cut.repartitionByRange("tile").sortWithinPartitions("tile").select(f("tile", "values").alias("x"))
    columns, tform = [F.col("x.data").alias("COMPRESSED_DATA")], {"COMPRESSED_DATA": "1PI" if name == "PLIO_1" else "1PB"}
    if z.method is not None:
        columns += [F.col("x.whole").alias("GZIP_COMPRESSED_DATA"), F.col("x.step").alias("ZSCALE"), F.col("x.zero").alias("ZZERO")]
        tform |= {"GZIP_COMPRESSED_DATA": "1PB", "ZSCALE": "1D", "ZZERO": "1D"}
    cards = z.cards() + ([("BZERO", zero, "offset data range to that of unsigned"), ("BSCALE", 1, "default scaling factor")] if zero else [])
    write_fits(rows.select(columns), path, single=True, tform=tform, cards={"cards": cards}, checksum=checksum)
    target = files.local(path.removeprefix("!"))
    with files.open_bytes(target) as got:
        n = files.scan(got)[1].header.integer("NAXIS2")
    if n != z.rows:
        os.remove(target)
        raise FitsError(308, f"{n} tiles of {z.rows}")


def write_compressed_pixels(df: DataFrame, path: str, hdu: int = 2, *, level: float = 4.0, value: str = "value", pix: str = "_pix") -> None:
    """Pixels of (_pix from 1, value) into a compressed image that is there; the others stay. Only tiles with such pixels are decoded and coded again,
    the others keep their bytes, and so do the file's other HDUs and the header's other cards. Of a pixel given twice the larger value holds.

    Null is NaN in floats, status 314 in integers. A pixel outside the image: status 308; not a compressed image, or one with columns other than those of HOLDS: 233.
    """
    spark, name = df.sparkSession, _place(path)
    found = files.find(_scan(path), hdu)
    h, z = found.header, zimage.parse(found.header)
    columns = tb.layout(h).columns if z else []
    if not columns or any(c.name.upper() not in HOLDS for c in columns):
        raise FitsError(233)
    bitpix, zero = z.bitpix, int(h.get("BZERO", 0))
    table = codec.dither_table() if z.method else None
    number, place = tile_of(F.col("_pix"), z.axes, z.tile)
    total = int(np.prod(z.axes))
    inside = F.when(F.col("_pix").between(1, total), F.col("_pix")).otherwise(F.raise_error(F.lit(str(FitsError(308)))))
    new = df.select(F.col(pix).cast("long").alias("_pix"), _stored(value, bitpix, zero).alias("v")).withColumn("_pix", inside)
    new = new.select(number.alias("tile"), F.struct(place.alias("p"), "v").alias("x")).groupBy("tile").agg(F.array_sort(F.collect_list("x")).alias("x"))
    new = new.select("tile", F.col("x.p").alias("p"), F.col("x.v").alias("v"))

    @F.pandas_udf("data binary, whole binary, step double, zero double")
    def f(rows: pd.Series, old: pd.DataFrame, places: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = []
        for row, t, p, v in zip(rows, old.itertuples(index=False), places, values, strict=True):
            step, low = (None if x is None or x != x else x for x in (t.step, t.zero))
            if p is None:
                out.append((t.data, t.whole, step, low))
                continue
            v = np.asarray(v, object if bitpix > 0 else float)
            if bitpix > 0 and any(x is None or x != x for x in v):
                raise FitsError(314)
            cells = z.decode(int(row), t.data, t.whole, step, low, table).astype(np.int64 if bitpix > 0 else np.float64)
            cells[np.asarray(p, np.int64)] = v
            out.append(z.encode(int(row), cells, level, table))
        return pd.DataFrame(out, columns=["data", "whole", "step", "zero"])

    old = read_fits(spark, path, hdu=hdu, tiles=True).join(new, "tile", "left")
    rows = old.repartitionByRange("tile").sortWithinPartitions("tile").select(f("tile", F.struct("data", "whole", "step", "zero"), "p", "v").alias("x"))
    stage = f"{name}.tmp-{uuid.uuid4().hex}"
    tform = {c.name: f"{c.form.repeat}{c.form.descriptor}{c.form.letter}" for c in columns}
    try:
        write_fits(rows.select(*[F.col(f"x.{HOLDS[c.name.upper()]}").alias(c.name) for c in columns]), stage, single=True, tform=tform)
        made = _scan(stage)[1]
        h.modify("PCOUNT", made.header.get("PCOUNT"))
        for i in range(1, len(columns) + 1):
            h.modify(f"TFORM{i}", made.header.get(f"TFORM{i}"))
        if h.has("THEAP"):
            h.delete("THEAP")
        _splice(name, stage, found, made)
    finally:
        for left in (stage, stage + ".whole"):
            if os.path.exists(left):
                os.remove(left)


def _splice(name: str, stage: str, old: files.Hdu, new: files.Hdu) -> None:
    """The file with an HDU's data replaced by those of another file, under the old header, which has been edited."""
    with open(name, "rb") as was, open(stage, "rb") as data, open(stage + ".whole", "wb") as out:
        if old.header.has("DATASUM"):
            total = 0
            data.seek(new.data_start)
            while more := data.read(2880 * 4096):
                total = sums.add(total, more)
            sums.seal(old.header, total)
        _copy(was, out, 0, old.header_start)
        out.write(old.header.to_bytes())
        _copy(data, out, new.data_start, new.end)
        was.seek(old.end)
        shutil.copyfileobj(was, out, 1 << 24)
    os.replace(stage + ".whole", name)


def _copy(f, out, start: int, end: int) -> None:
    f.seek(start)
    while start < end:
        block = f.read(min(1 << 24, end - start))
        if not block:
            raise FitsError(108)
        out.write(block)
        start += len(block)
