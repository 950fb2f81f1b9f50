"""The data source "fits": tables and images as DataFrames, and DataFrames as binary or ASCII tables."""

from __future__ import annotations

import gzip
import json
import os
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..codecs import tiles as codec
from ..format import tables as tb
from ..format import zimage
from ..format.header import Header
from ..format.status import FitsError
from ..functions import checksum as sums
from . import files

#: Bytes of rows or pixels that one partition reads, and that one batch holds.
PART, BATCH = 64 << 20, 4 << 20
#: BITPIX and BZERO of an image, numpy's stored type, Arrow's type of a pixel.
PIXELS = {
    (8, 0): ("u1", pa.int16()), (8, -128): ("u1", pa.int8()), (16, 0): (">i2", pa.int16()), (16, 1 << 15): (">i2", pa.int32()), (32, 0): (">i4", pa.int32()), (32, 1 << 31): (">i4", pa.int64()),
    (64, 0): (">i8", pa.int64()), (64, 1 << 63): (">i8", pa.decimal128(20, 0)), (-32, 0): (">f4", pa.float32()), (-64, 0): (">f8", pa.float64()),
}
IMAGE_TYPES = {"u8": (8, 0), "i8": (8, -128), "i16": (16, 0), "u16": (16, 1 << 15), "i32": (32, 0), "u32": (32, 1 << 31), "i64": (64, 0), "u64": (64, 1 << 63), "f32": (-32, 0), "f64": (-64, 0)}


TILES = pa.schema([("tile", pa.int64()), ("data", pa.binary()), ("whole", pa.binary()), ("step", pa.float64()), ("zero", pa.float64())])


@dataclass
class Slice(InputPartition):
    path: str
    hdu: files.Hdu  # with its header and places, so that no slice scans the file again
    first: int
    count: int


def _options(o: dict) -> dict:
    return {"hdu": o.get("hdu"), "extname": o.get("extname"), "extver": int(o.get("extver", 0))}


def _pixel(h: Header) -> tuple[str, pa.DataType, float, float]:
    bitpix, zero, scale = h.integer("ZBITPIX" if h.get("ZIMAGE", False) is True else "BITPIX"), float(h.get("BZERO", 0)), float(h.get("BSCALE", 1))
    if scale == 1 and (bitpix, int(zero)) in PIXELS and zero == int(zero):
        return *PIXELS[bitpix, int(zero)], 1.0, zero
    return PIXELS[bitpix, 0][0], pa.float64(), scale, zero


def _schema(hdu: files.Hdu, options: dict) -> pa.Schema:
    """What is read of an HDU."""
    if options.get("raw") == "true":
        return pa.schema([("row", pa.int64()), ("bytes", pa.binary())])
    if options.get("tiles") == "true":
        if zimage.parse(hdu.header) is None:
            raise FitsError(233)
        return TILES
    if hdu.kind == "image":
        return pa.schema([("_pix", pa.int64()), ("value", _pixel(hdu.header)[1])])
    lay = tb.layout(hdu.header)
    wanted = [x.strip() for x in options["columns"].split(",")] if options.get("columns") else [c.name for c in lay.columns]
    by = {c.name.lower(): c for c in lay.columns}
    if missing := [x for x in wanted if x.lower() not in by]:
        raise FitsError(219, *missing)
    fields = [(by[x.lower()].name, by[x.lower()].arrow()) for x in wanted]
    return pa.schema(([("_row", pa.int64())] if options.get("rowid") == "true" else []) + fields)


def _fits_dims(c: tb.Column) -> bool:
    try:
        return bool(tb.dims_of(c))
    except FitsError:
        return False


class FitsSource(DataSource):
    """Options: path (a file, or a folder of files alike), hdu | extname [extver], columns (a,b,...: only these are decoded),
    raw (true: row and its bytes), tiles (true: those of a compressed image as they are stored: tile from 1, data, whole, step, zero), rowid (true: _row from 1 within the file), firstrow, lastrow. Images come as
    (_pix from 1, value), in the order of the file, the first axis fastest."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def _hdu(self) -> tuple[list[str], files.Hdu]:
        paths = files.list_files(self.options["path"])
        if not paths:
            raise FitsError(104, self.options["path"])
        with files.open_bytes(paths[0]) as f:
            return paths, files.find(files.scan(f), **_options(self.options))

    def arrow_schema(self) -> pa.Schema:
        return _schema(self._hdu()[1], self.options)

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        hdu = self._hdu()[1]
        out = from_arrow_schema(_schema(hdu, self.options))
        if hdu.kind != "image" and self.options.get("raw") != "true":
            about = {c.name: c for c in tb.layout(hdu.header).columns}
            for f in out.fields:
                if c := about.get(f.name):
                    f.metadata = {k: v for k, v in (("tunit", c.unit), ("tdim", c.dim)) if v}
        return out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FitsReader(dict(self.options), self.arrow_schema())

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FitsWriter(dict(self.options), schema, overwrite)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return FitsStream(dict(self.options), self.arrow_schema())


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema) -> None:
        self.options, self.schema = options, schema
        self.low, self.high = int(options.get("firstrow", 1)), int(options.get("lastrow", 1 << 62))

    def pushFilters(self, filters):  # noqa: N802
        """Bounds on _row and _pix choose what is read; Spark applies all filters again."""
        for f in filters:
            column, value, kind = getattr(f, "attribute", None), getattr(f, "value", None), type(f).__name__
            if column in (("_row",), ("_pix",)) and isinstance(value, int):
                if kind in ("EqualTo", "GreaterThanOrEqual", "GreaterThan"):
                    self.low = max(self.low, value + (kind == "GreaterThan"))
                if kind in ("EqualTo", "LessThanOrEqual", "LessThan"):
                    self.high = min(self.high, value - (kind == "LessThan"))
            yield f

    def partitions(self) -> list[Slice]:
        return self.planned(files.list_files(self.options["path"]))

    def planned(self, paths: list[str]) -> list[Slice]:
        """The slices of all files; headers are read by several threads, as they wait for storage mostly."""
        with ThreadPoolExecutor(max(1, min(32, len(paths)))) as pool:
            return [s for some in pool.map(self.slices, paths) for s in some]

    def slices(self, path: str) -> list[Slice]:
        with files.open_bytes(path) as f:
            return self.slices_of(f, path, isinstance(f, gzip.GzipFile))

    def slices_of(self, f, path: str, whole: bool) -> list[Slice]:
        """Of an open file; whole: all rows in one, as their places can't be reached otherwise."""
        hdu = files.find(files.scan(f), **_options(self.options))
        z = zimage.parse(hdu.header) if self.options.get("raw") != "true" else None
        if z:
            first, last = z.rows_of(max(self.low, 1), self.high)
            step = max(1, z.rows if whole else int(self.options.get("partbytes", PART)) // (z.width * int(np.prod(z.tile))))
            return [Slice(path, hdu, a, min(step, last - a + 1)) for a in range(first, last + 1, step)]
        if hdu.kind == "image" and self.options.get("raw") != "true":
            unit = abs(hdu.header.integer("BITPIX")) // 8
            total = hdu.data_bytes // unit
        else:
            unit, total = hdu.header.integer("NAXIS1"), hdu.header.integer("NAXIS2")
        low, high = max(self.low, 1), min(self.high, total)
        step = max(1, total if whole else int(self.options.get("partbytes", PART)) // max(unit, 1))
        return [Slice(path, hdu, a, min(step, high - a + 1)) for a in range(low, high + 1, step)]

    def read(self, part: Slice | None):
        if part is None:  # no slice at all: an empty table, or bounds outside it
            return
        with files.open_bytes(part.path) as f:
            yield from self.read_of(f, part)

    def read_of(self, f, part: Slice):
        hdu = part.hdu
        if self.options.get("raw") == "true":
            width = hdu.header.integer("NAXIS1")
            for a, n, data in self._blocks(f, hdu, part, width):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.array([data[i * width : (i + 1) * width] for i in range(n)], pa.binary())], schema=self.schema)
        elif z := zimage.parse(hdu.header):
            if self.options.get("tiles") == "true":
                for t in self._tiles(f, hdu, part):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(t, TILES, strict=True)], schema=TILES)
            else:
                yield from self._pixels(f, hdu, part, z)
        elif hdu.kind == "image":
            kind, arrow, scale, zero = _pixel(hdu.header)
            blank = hdu.header.get("BLANK")
            for a, n, data in self._blocks(f, hdu, part, np.dtype(kind).itemsize):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pixels(np.frombuffer(data, kind), arrow, scale, zero, blank)], schema=self.schema)
        else:
            lay = tb.layout(hdu.header, hdu.data_start)
            names = [x for x in self.schema.names if x != "_row"]

            def heap(offset: int, size: int) -> bytes:
                if offset < 0 or lay.heap + offset + size > hdu.data_bytes:
                    raise FitsError(264)
                f.seek(lay.data_start + lay.heap + offset)
                return f.read(size)

            for a, n, data in self._blocks(f, hdu, part, lay.row_bytes):
                columns = tb.decode(lay, data, heap, names)
                if "_row" in self.schema.names:
                    columns = [pa.array(np.arange(a, a + n)), *columns]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def _pixels(self, f, hdu: files.Hdu, part: Slice, z: zimage.ZImage):
        """The pixels of compressed tiles, a batch for each."""
        _, arrow, scale, zero = _pixel(hdu.header)
        blank = hdu.header.get("ZBLANK", hdu.header.get("BLANK")) if z.bitpix > 0 else None
        table = codec.dither_table() if z.method else None
        for row, data, whole, step, low in self._tiles(f, hdu, part):
            stored = z.decode(row, data, whole, step, low, table)
            yield pa.RecordBatch.from_arrays([pa.array(z.pixels(row)), pixels(stored, arrow, scale, zero, blank)], schema=self.schema)

    def _tiles(self, f, hdu: files.Hdu, part: Slice):
        """(row, data, data of floats kept whole, step, zero) of compressed tiles."""
        lay = tb.layout(hdu.header, hdu.data_start)
        of = {c.name.upper(): c for c in lay.columns}

        def heap(cells: np.ndarray, name: str) -> bytes:
            if name not in of:
                return b""
            c = of[name]
            n, offset = cells[c.offset : c.offset + c.form.nbytes].view(">i4" if c.form.descriptor == "P" else ">i8").tolist()
            size = n * tb.WIDTH[c.form.letter]
            if offset < 0 or lay.heap + offset + size > hdu.data_bytes:
                raise FitsError(264)
            f.seek(lay.data_start + lay.heap + offset)
            return f.read(size)

        def number(cells: np.ndarray, name: str) -> float | None:
            x = float(cells[of[name].offset :][:8].view(">f8")[0]) if name in of else None
            return None if x is None or x != x else x

        for a, n, data in self._blocks(f, hdu, part, lay.row_bytes):
            for row, cells in enumerate(np.frombuffer(data, np.uint8).reshape(n, -1), a):
                yield row, heap(cells, "COMPRESSED_DATA"), heap(cells, "GZIP_COMPRESSED_DATA"), number(cells, "ZSCALE"), number(cells, "ZZERO")

    @staticmethod
    def _blocks(f, hdu: files.Hdu, part: Slice, unit: int):
        step = max(1, BATCH // max(unit, 1))
        for a in range(part.first, part.first + part.count, step):
            n = min(step, part.first + part.count - a)
            f.seek(hdu.data_start + (a - 1) * unit)
            data = f.read(n * unit)
            if len(data) < n * unit:
                raise FitsError(108, part.path)
            yield a, n, data


def pixels(stored: np.ndarray, arrow: pa.DataType, scale: float, zero: float, blank: int | None) -> pa.Array:
    mask = stored == blank if blank is not None and stored.dtype.kind in "iu" else None
    native = stored.astype(stored.dtype.newbyteorder("="))
    if pa.types.is_decimal(arrow):
        return tb.unsigned(native, mask)
    if scale != 1 or (zero and pa.types.is_float64(arrow)):
        return pa.array(native * scale + zero, pa.float64(), mask=mask)
    return pa.array(native.astype(np.int64) + int(zero), mask=mask).cast(arrow) if zero else pa.array(native, mask=mask).cast(arrow)


def stored_pixels(values: pa.Array, dtype: np.dtype, zero: int, blank: int | None) -> np.ndarray:
    """Whole numbers as they are stored: rounded half away from zero, moved by zero, null as blank; status 314 or 412 where that can't be."""
    nulls = np.asarray(values.is_null())
    if nulls.any() and blank is None:
        raise FitsError(314)
    limits = np.iinfo(dtype.newbyteorder("="))
    if zero == 1 << 63:
        if not pa.types.is_decimal(values.type):
            values = pc.round(values, round_mode="half_towards_infinity").cast(pa.decimal128(38, 0), safe=False)
        out = tb.signed(values)
    else:
        if pa.types.is_decimal(values.type):
            values = values.cast(pa.int64())
        x = values.fill_null(zero).to_numpy(zero_copy_only=False)
        if x.dtype.kind == "f":
            x = np.sign(x) * np.floor(np.abs(x) + 0.5)
        if len(x) and not (x.min() >= limits.min + zero and x.max() <= limits.max + zero):
            raise FitsError(412)
        out = x.astype(np.int64) - zero
    if nulls.any():
        out[nulls] = blank
    return out.astype(dtype)


class FitsStream(DataSourceStreamReader):
    """New files of a folder, in order of name; an offset is the last name taken."""

    def __init__(self, options: dict, schema: pa.Schema) -> None:
        self.inner = FitsReader(options, schema)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        names = files.list_files(self.inner.options["path"])
        return {"after": os.path.basename(names[-1]) if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        names = [p for p in files.list_files(self.inner.options["path"]) if start["after"] < os.path.basename(p) <= end["after"]]
        return self.inner.planned(names)

    def read(self, part: Slice):
        return self.inner.read(part)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: a whole file, or with single=true its rows and their heap."""

    name: str
    n: int
    heap_bytes: int
    longest: dict


class FitsWriter(DataSourceArrowWriter):
    """One file of each task, or with single=true one in all. Options: path, tform (JSON: column to format), tunit, tdim, tnull,
    tscal, tzero (JSON too; tunit and tdim else by the columns' metadata, which reading a table sets), extname, kind=binary|ascii, compression=gzip, checksum=true, single=true. Without a format strings
    and arrays become cells of variable length. cards (JSON: {"cards": [[name, value, comment]]}) end the header. Tasks write whole files
    beside the target and committing renames them; with single=true the driver joins the tasks' rows and heaps. The target is a mounted folder or any
    store that Arrow knows (mounted=false: treat it as one); there a task writes its rows before its file, as nothing can be written over."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        path = options["path"]
        self.clobber = overwrite or path.startswith("!")
        self.place = files.place(path.removeprefix("!"), options.get("mounted") != "false")
        self.path, self.mounted = self.place.path, isinstance(self.place, files.Mounted)
        given = {k: json.loads(options.get(k, "{}")) for k in ("tform", "tunit", "tdim", "tnull", "tscal", "tzero")}
        self.ascii = options.get("kind") == "ascii"
        self.cards = json.loads(options.get("cards", "{}")).get("cards", [])
        self.columns, at = [], 0
        if len(schema.fields) > 999:
            raise FitsError(216, f"{len(schema.fields)} columns")
        for f in schema.fields:
            text = given["tform"].get(f.name) or default_tform(f.dataType, self.ascii)
            if self.ascii:
                form, zero = tb.parse_ascii_tform(text), 0
            else:
                form = tb.parse_tform(text)
                form.letter, zero = tb.STORED.get(form.letter, (form.letter, 0))
            known = {k: given[k].get(f.name, (f.metadata or {}).get(k, "")) for k in ("tunit", "tdim")}
            c = tb.Column(f.name, form, given["tscal"].get(f.name, 1), given["tzero"].get(f.name, zero), given["tnull"].get(f.name), at, known["tunit"], known["tdim"])
            if f.name in given["tdim"]:
                tb.dims_of(c)
            elif not self.ascii and not _fits_dims(c):
                c.dim = ""
            self.columns.append(c)
            at += form[1] + 1 if self.ascii else form.nbytes
        self.stage = f"{self.path}.tmp-{uuid.uuid4().hex}"

    def write(self, batches) -> Part:
        self.place.folder(self.stage)
        whole = self.options.get("single") != "true"
        base = f"{self.stage}/{uuid.uuid4().hex}"
        n, heap_at = 0, 0
        longest: dict[int, int] = {}
        with self.place.create(base) as rows, self.place.create(base + ".heap") as heaps:
            if whole and self.mounted:  # the header has as many cards whatever its numbers are, so it comes last, into this place
                rows.write(bytes(len(self._head(0, 0, {}, 0))))
            for batch in batches:
                heap = bytearray()
                if self.ascii:
                    rows.write(tb.encode_ascii(self.columns, batch))
                else:
                    data = bytearray(tb.encode(self.columns, batch, heap))
                    for i, c in enumerate(self.columns):
                        if c.form.descriptor and batch.num_rows:
                            d = self._descriptors(data, batch.num_rows, c)
                            longest[i] = max(longest.get(i, 0), int(d[:, 0].max()))
                            d[:, 1] += heap_at * (d[:, 0] > 0)
                    rows.write(data)
                    heaps.write(heap)
                heap_at += len(heap)
                n += batch.num_rows
        part = Part(base, n, heap_at, longest)
        if n and whole and not self.mounted:
            self._join(base + ".whole", [part])
            part.name += ".whole"
        elif n and whole:
            with open(base, "r+b") as f:
                f.seek(0, os.SEEK_END)
                self._end(f, part, len(self._head(0, 0, {}, 0)))
            if self._gzip():
                with open(base, "rb") as f, gzip.open(base + ".gz", "wb", 6) as z:
                    shutil.copyfileobj(f, z, 1 << 24)
                os.replace(base + ".gz", base)
        return part

    def _gzip(self) -> bool:
        return self.options.get("compression") == "gzip"

    def _descriptors(self, data: bytearray, n: int, c: tb.Column) -> np.ndarray:
        width = sum(x.form.nbytes for x in self.columns)
        return np.ndarray((n, 2), ">i4" if c.form.descriptor == "P" else ">i8", data, c.offset, (width, c.form.nbytes // 2))

    def _head(self, n: int, heap: int, longest: dict, total: int) -> bytes:
        """An empty primary and the table's header; total: the sum of the data's words."""
        for i, c in enumerate(self.columns):
            if not self.ascii and c.form.descriptor:
                c.form.width = longest.get(i, 0)
        extname = self.options.get("extname", "")
        h = tb.ascii_header(self.columns, n, extname) if self.ascii else tb.table_header(self.columns, n, heap, extname)
        for card in self.cards:
            h.write(*card)
        if self.options.get("checksum") == "true":
            h = sums.seal(h, total)
        return tb.empty_primary() + h.to_bytes()

    def _end(self, f, part: Part, start: int) -> None:
        """Puts the heap behind the rows, which end where f is, fills the last record and writes the header at the front."""
        with open(part.name + ".heap", "rb") as heap:
            shutil.copyfileobj(heap, f, 1 << 24)
        f.write(self._fill(f.tell() - start))
        total = 0
        if self.options.get("checksum") == "true":
            f.seek(start)
            while data := f.read(2880 * 4096):
                total = sums.add(total, data)
        f.seek(0)
        f.write(self._head(part.n, part.heap_bytes, part.longest, total))

    def _fill(self, size: int) -> bytes:
        return (b" " if self.ascii else b"\0") * (-size % 2880)

    def commit(self, messages: list) -> None:
        parts = [m for m in messages if m is not None]
        single = self.options.get("single") == "true"
        if self.place.exists(self.path):
            if not self.clobber:
                self.place.remove(self.stage)
                raise FitsError(105, self.path)
            self.place.remove(self.path)
        name = lambda k: f"{self.path}/part-{k:05d}.fits" + ".gz" * self._gzip()
        if not single:
            self.place.folder(self.path)
            for k, p in enumerate(p for p in parts if p.n):
                self.place.move(p.name, name(k))
        if single or not any(p.n for p in parts):
            self.place.folder(self.stage)
            joined = f"{self.stage}/joined"
            self._join(joined, parts if single else [])
            self.place.move(joined, self.path if single else name(0))
        self.place.remove(self.stage)

    def _join(self, name: str, parts: list[Part]) -> None:
        """One file of tasks' rows and heaps, from its start to its end."""
        total = 0
        if self.options.get("checksum") == "true":
            rest = b""
            for data in self._data(parts):
                data = rest + data
                whole = len(data) // 4 * 4
                total, rest = sums.add(total, data[:whole]), data[whole:]
        longest = {i: max(p.longest.get(i, 0) for p in parts) for i in range(len(self.columns))} if parts else {}
        with self.place.create(name) as out:
            f = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6) if self._gzip() else out
            f.write(self._head(sum(p.n for p in parts), sum(p.heap_bytes for p in parts), longest, total))
            for data in self._data(parts):
                f.write(data)
            if f is not out:
                f.close()

    def _data(self, parts: list[Part]):
        """The data unit in blocks: rows, whose descriptors move by the heaps before theirs, heaps, and fill up to a whole record."""
        moved = [c for c in self.columns if not self.ascii and c.form.descriptor]
        width = 1 if self.ascii else max(1, sum(c.form.nbytes for c in self.columns))
        before, size = 0, 0
        for p in parts:
            with self.place.open(p.name) as f:
                while data := f.read(max(1, (1 << 24) // width) * width):
                    if before and moved:
                        data = bytearray(data)
                        for c in moved:
                            d = self._descriptors(data, len(data) // width, c)
                            d[:, 1] += before * (d[:, 0] > 0)
                    size += len(data)
                    yield bytes(data)
            before += p.heap_bytes
        for p in parts:
            with self.place.open(p.name + ".heap") as f:
                while data := f.read(1 << 24):
                    size += len(data)
                    yield data
        yield self._fill(size)

    def abort(self, messages: list) -> None:
        self.place.remove(self.stage)


def default_tform(t: T.DataType, ascii_: bool = False) -> str:
    """The format of a type; those that cells can't hold, such as dates, decimals with a fraction and arrays of texts: status 410."""
    one = {T.BooleanType: "L", T.ByteType: "S", T.ShortType: "I", T.IntegerType: "J", T.LongType: "K", T.FloatType: "E", T.DoubleType: "D", T.TimestampType: "K", T.TimestampNTZType: "K"}
    if ascii_:
        return {T.StringType: "A32", T.FloatType: "E16.8", T.DoubleType: "D25.16"}.get(type(t), "I20")
    if type(t) in one:
        return "1" + one[type(t)]
    if isinstance(t, T.DecimalType) and t.scale == 0:
        return "1W"
    if isinstance(t, (T.StringType, T.BinaryType)):
        return "1PA" if isinstance(t, T.StringType) else "1PB"
    if isinstance(t, T.StructType):
        return "1C" if isinstance(t.fields[0].dataType, T.FloatType) else "1M"
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.ArrayType, T.StringType, T.BinaryType)):
        return "1PX" if isinstance(t.elementType, T.BooleanType) else "1P" + default_tform(t.elementType)[-1]
    raise FitsError(410, t.simpleString())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsSource)


def write_fits(df: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Writes df; dicts among the options go as JSON. Timestamps are stored as microseconds."""
    register(df.sparkSession)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            df = df.withColumn(f.name, F.unix_micros(F.col(f.name).cast("timestamp")))
    w = df.write.format("fits").mode(mode)
    for k, v in options.items():
        w = w.option(k, json.dumps(v) if isinstance(v, dict) else str(v).lower() if isinstance(v, bool) else v)
    w.save(path)


def read_fits(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    r = spark.read.format("fits")
    for k, v in options.items():
        r = r.option(k, ",".join(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v)
    return r.load(path)


def read_fits_content(df: DataFrame, content: str = "content", keep: list[str] | None = None, **options) -> DataFrame:
    """Rows or pixels of files that lie in a binary column, plain or gzipped, as spark.read.format("binaryFile") gives them; a file is a unit of
    work and held in memory. keep: columns of df to repeat beside each row. Files are alike: the first one tells the columns. Options as in
    read_fits. Null gives no rows, no file at all status 104."""
    from pyspark.sql.pandas.types import from_arrow_schema

    given = {k: ",".join(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    keep = keep or []
    first = df.where(F.col(content).isNotNull()).select(content).first()
    if first is None:
        raise FitsError(104, content)
    kinds = _schema(files.find(files.scan_bytes(bytes(first[0])), **_options(given)), given)

    def run(batches):
        for b in batches:
            for i, data in enumerate(b.column(0)):
                if not data.is_valid:
                    continue
                f, reader = files.in_memory(data.as_py()), FitsReader(given, kinds)
                for part in reader.slices_of(f, "", False):
                    for rows in reader.read_of(f, part):
                        yield pa.RecordBatch.from_arrays([*[pa.repeat(b.column(k)[i], rows.num_rows) for k in range(1, b.num_columns)], *rows.columns], names=out.names)

    out = T.StructType([df.schema[k] for k in keep] + from_arrow_schema(kinds).fields)
    return df.select(content, *keep).mapInArrow(run, out)


def fits_hdus(spark: SparkSession, path: str) -> DataFrame:
    """One row per HDU of each file; data are not read."""
    paths = spark.createDataFrame([(p,) for p in files.list_files(path)], "path string")

    def run(batches):
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                with files.open_bytes(p) as f:
                    rows += [{"path": p, "hdu": x.number, "type": x.kind, "extname": x.header.get("EXTNAME"), "header_start": x.header_start, "data_start": x.data_start, "data_bytes": x.data_bytes} for x in files.scan(f)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("hdu", pa.int32()), ("type", pa.string()), ("extname", pa.string()), ("header_start", pa.int64()), ("data_start", pa.int64()), ("data_bytes", pa.int64())]))

    return paths.mapInArrow(run, "path string, hdu int, type string, extname string, header_start long, data_start long, data_bytes long")


def fits_columns(spark: SparkSession, path: str) -> DataFrame:
    """One row per column of each table of each file, pos from 1; dims by TDIM, null where it does not fit the format."""
    paths = spark.createDataFrame([(p,) for p in files.list_files(path)], "path string")
    kinds = pa.schema(
        [("path", pa.string()), ("hdu", pa.int32()), ("extname", pa.string()), ("rows", pa.int64()), ("pos", pa.int32()), ("name", pa.string()), ("tform", pa.string())]
        + [("start", pa.int64()), ("nbytes", pa.int64()), ("unit", pa.string()), ("scale", pa.float64()), ("zero", pa.float64()), ("dims", pa.list_(pa.int64()))]
    )

    def run(batches):
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                with files.open_bytes(p) as f:
                    for x in files.scan(f):
                        if x.kind == "image":
                            continue
                        lay = tb.layout(x.header)
                        for i, c in enumerate(lay.columns, 1):
                            size = c.form[1] if isinstance(c.form, tuple) else c.form.nbytes
                            about = {"name": c.name, "tform": x.header.string(f"TFORM{i}").strip(), "start": c.offset, "nbytes": size, "unit": c.unit or None, "scale": c.scale, "zero": c.zero}
                            rows.append({"path": p, "hdu": x.number, "extname": x.header.get("EXTNAME"), "rows": lay.rows, "pos": i, "dims": tb.dims_of(c) if _fits_dims(c) else None, **about})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    from pyspark.sql.pandas.types import from_arrow_schema

    return paths.mapInArrow(run, from_arrow_schema(kinds))


def fits_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per card, in order of idx, from 1."""
    from ..format import cards as C

    paths = spark.createDataFrame([(p,) for p in files.list_files(path)], "path string")
    kinds = pa.schema([("path", pa.string()), ("hdu", pa.int32()), ("idx", pa.int32()), ("keyword", pa.string()), ("value", pa.string()), ("comment", pa.string()), ("class", pa.int32()), ("card", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                with files.open_bytes(p) as f:
                    for x in files.scan(f):
                        for i, c in enumerate(x.header.cards, 1):
                            value, comment = C.parse(c)
                            rows.append({"path": p, "hdu": x.number, "idx": i, "keyword": C.keyword(c), "value": value, "comment": comment, "class": C.key_class(c), "card": c})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return paths.mapInArrow(run, "path string, hdu int, idx int, keyword string, value string, comment string, class int, card string")


def image_header(axes: list[int], kind: str, blank: int | None = None, extension: bool = False) -> Header:
    """Of an image, primary or extension. kind: a name of IMAGE_TYPES."""
    bitpix, zero = IMAGE_TYPES[kind]
    h = Header().write("XTENSION", "IMAGE", "IMAGE extension") if extension else Header().write("SIMPLE", True, "file does conform to FITS standard")
    h.write("BITPIX", bitpix, "number of bits per data pixel").write("NAXIS", len(axes), "number of data axes")
    for i, n in enumerate(axes, 1):
        h.write(f"NAXIS{i}", n, f"length of data axis {i}")
    if extension:
        h.write("PCOUNT", 0, "required keyword; must = 0").write("GCOUNT", 1, "required keyword; must = 1")
    else:
        h.write("EXTEND", True, "FITS dataset may contain extensions")
    if zero:
        h.write("BZERO", zero, "offset data range to that of unsigned").write("BSCALE", 1, "default scaling factor")
    if blank is not None:
        h.write("BLANK", blank)
    return h


def _place(path: str) -> str:
    name = files.local(path)
    if name is None:
        raise FitsError(105, "only folders that are mounted can be written")
    return name


def _scan(path: str) -> list[files.Hdu]:
    with files.open_bytes(path) as f:
        if isinstance(f, gzip.GzipFile):
            raise FitsError(112, path)
        return files.scan(f)


def _lay_out(spark: SparkSession, name: str, at: int, header: Header) -> files.Hdu:
    """Writes a header at a place of a file and cuts or extends the file to its data, which are 0: tasks fill them where 0 is not stored as such."""
    head, size = header.to_bytes(), tb.geometry(header)
    with open(name, "r+b" if os.path.exists(name) else "wb") as f:
        f.truncate(at)
        f.seek(at)
        f.write(head)
        f.truncate(at + len(head) + -(-size // 2880) * 2880)
    bitpix, zero = header.integer("BITPIX"), int(header.get("BZERO", 0))
    if zero and size:  # 0 is stored as -zero
        dtype, block = np.dtype(PIXELS[bitpix, zero][0]), 1 << 22
        total, start = size // dtype.itemsize, at + len(head)

        def fill(batches):
            with open(name, "r+b") as f:
                for b in batches:
                    for k in b.column(0).to_pylist():
                        f.seek(start + k * block * dtype.itemsize)
                        f.write(np.full(min(block, total - k * block), -zero, np.int64).astype(dtype).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        spark.range(-(-total // block)).mapInArrow(fill, "n long").agg(F.sum("n")).collect()
    return files.Hdu(0, header, at, at + len(head), size)


def write_image(df: DataFrame, path: str, axes: list[int], kind: str, value: str = "value", pix: str = "_pix", blank: int | None = None, append: bool = False) -> None:
    """An image from (_pix from 1, value): tasks write their pixels into their places of one file, which the driver lays out.
    Pixels that df lacks are 0. kind: a name of IMAGE_TYPES. append: an IMAGE extension at the end of a file that is there, or its
    primary if that is all there is and empty; else the file must be new."""
    name, at = _place(path), 0
    if append:
        hdus = _scan(path)
        lone = len(hdus) == 1 and hdus[0].kind == "image" and not hdus[0].data_bytes
        at = 0 if lone else hdus[-1].end
    elif os.path.exists(name):
        raise FitsError(105, path)
    hdu = _lay_out(df.sparkSession, name, at, image_header(axes, kind, blank, at > 0))
    _write_pixels(df, name, hdu, value, pix)


def write_pixels(df: DataFrame, path: str, hdu: int = 1, value: str = "value", pix: str = "_pix") -> None:
    """Pixels of (_pix from 1, value) into their places of an image that is there; the others stay. For compressed images there is
    write_compressed_pixels; here they give status 233."""
    found = files.find(_scan(path), hdu)
    if found.kind != "image" or found.header.get("ZIMAGE", False) is True:
        raise FitsError(233)
    _write_pixels(df, _place(path), found, value, pix)


def resize_image(spark: SparkSession, path: str, axes: list[int], kind: str) -> None:
    """Gives the last HDU, an image, another size and type; its pixels are 0 then. Another HDU: status 201."""
    last = _scan(path)[-1]
    if last.kind != "image" or last.header.get("ZIMAGE", False) is True:
        raise FitsError(201, "only an image at the end can be resized")
    _lay_out(spark, _place(path), last.header_start, image_header(axes, kind, extension=last.header_start > 0))


def image_size(path: str, hdu: int = 1) -> tuple[str, list[int]]:
    """(name of its type, axes) of an image, of a compressed one those of its pixels."""
    h = files.find(_scan(path), hdu).header
    z = "Z" if h.get("ZIMAGE", False) is True else ""
    if not z and h.get("XTENSION", "IMAGE").strip() != "IMAGE":
        raise FitsError(233)
    code = (h.integer(z + "BITPIX"), int(h.get("BZERO", 0)))
    kinds = {v: k for k, v in IMAGE_TYPES.items()}
    return kinds.get(code) or kinds[code[0], 0], [h.integer(f"{z}NAXIS{i}") for i in range(1, h.integer(z + "NAXIS") + 1)]


def _write_pixels(df: DataFrame, name: str, hdu: files.Hdu, value: str, pix: str) -> None:
    bitpix, zero, blank, start = hdu.header.integer("BITPIX"), int(hdu.header.get("BZERO", 0)), hdu.header.get("BLANK"), hdu.data_start
    dtype = np.dtype(PIXELS[bitpix, zero][0])
    total = hdu.data_bytes // dtype.itemsize

    def run(batches):
        with open(name, "r+b") as f:
            for b in batches:
                at, values = b.column(0).to_numpy(), b.column(1)
                if len(at) and (at.min() < 1 or at.max() > total):
                    raise FitsError(308)
                stored = values.to_numpy(zero_copy_only=False).astype(dtype) if bitpix < 0 else stored_pixels(values, dtype, zero, blank)
                order = np.argsort(at, kind="stable")
                _write_runs(f, at[order], stored[order], start, dtype.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array([len(at)])], names=["n"])

    df.select(F.col(pix).cast("long"), value).repartitionByRange(pix).sortWithinPartitions(pix).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _write_runs(f, at: np.ndarray, units: np.ndarray, start: int, size: int) -> None:
    """Units of `size` bytes into their places, from 1; neighbours at once."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if z > a:
            f.seek(start + (int(at[a]) - 1) * size)
            f.write(units[a:z].tobytes())


def write_rows(df: DataFrame, path: str, hdu: int = 2, row: str = "row", data: str = "bytes") -> None:
    """Whole rows (row from 1, bytes) into a table that is there, as raw="true" reads them. Rows past its end make it longer, which only the last
    HDU can be, without a heap (status 301 else); rows between that are not given are 0. A row of another size: status 308."""
    hdus = _scan(path)
    found, name = files.find(hdus, hdu), _place(path)
    if found.kind == "image":
        raise FitsError(235)
    h, width = found.header, found.header.integer("NAXIS1")
    last = df.agg(F.max(row)).first()[0] or 0
    if last > h.integer("NAXIS2"):
        if found.number != len(hdus) or h.get("PCOUNT", 0):
            raise FitsError(301, "rows can be added to the last HDU only")
        fill = (b" " if found.kind == "ascii" else b"\0") * (1 << 20)
        h.modify("NAXIS2", last)
        with open(name, "r+b") as f:
            f.seek(found.header_start)
            f.write(h.to_bytes())
            size = found.data_start + -(-width * last // 2880) * 2880
            f.truncate(size)
            if found.kind == "ascii":  # blanks, not 0, are empty there
                f.seek(found.end)
                while f.tell() < size:
                    f.write(fill[: size - f.tell()])

    def run(batches):
        with open(name, "r+b") as f:
            for b in batches:
                at, cells = b.column(0).to_numpy(), b.column(1).to_pylist()
                if any(x is None or len(x) != width for x in cells) or len(at) and at.min() < 1:
                    raise FitsError(308)
                order = np.argsort(at, kind="stable")
                _write_runs(f, at[order], np.array([cells[i] for i in order], f"V{width}"), found.data_start, width)
                yield pa.RecordBatch.from_arrays([pa.array([len(at)])], names=["n"])

    df.select(F.col(row).cast("long"), data).repartitionByRange(row).sortWithinPartitions(row).mapInArrow(run, "n long").agg(F.sum("n")).collect()
