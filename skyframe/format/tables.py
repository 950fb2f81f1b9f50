"""Tables: column formats, row layouts, and their bytes as Arrow columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .header import Header
from .status import FitsError

WIDTH = {"L": 1, "X": 1, "B": 1, "S": 1, "I": 2, "U": 2, "J": 4, "V": 4, "K": 8, "W": 8, "E": 4, "D": 8, "C": 8, "M": 16, "A": 1}
DTYPE = {"B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "C": ">f4", "M": ">f8"}
#: Letters of the writer that are stored as another with an offset.
STORED = {"S": ("B", -128), "U": ("I", 1 << 15), "V": ("J", 1 << 31), "W": ("K", 1 << 63)}
ARROW = {"L": pa.bool_(), "B": pa.int16(), "S": pa.int8(), "I": pa.int16(), "U": pa.int32(), "J": pa.int32(), "V": pa.int64(), "K": pa.int64(), "W": pa.decimal128(20, 0), "E": pa.float32(), "D": pa.float64()}
ARROW |= {c: pa.struct([("re", ARROW[p]), ("im", ARROW[p])]) for c, p in (("C", "E"), ("M", "D"))}


@dataclass
class Tform:
    """repeat, letter, descriptor (P, Q or empty), width of strings or most elements of a variable cell."""

    repeat: int
    letter: str
    descriptor: str = ""
    width: int = 0

    @property
    def nbytes(self) -> int:
        if self.descriptor:
            return self.repeat * (8 if self.descriptor == "P" else 16)
        return -(-self.repeat // 8) if self.letter == "X" else self.repeat * WIDTH[self.letter]

    def __str__(self) -> str:
        return f"{self.repeat}{self.descriptor}{self.letter}" + (f"({self.width})" if self.descriptor else "")


def parse_tform(text: str) -> Tform:
    """A binary format like 8E, 12A, 1PJ(5); status 261 or 262."""
    m = re.match(r"\s*(\d*)([PQpq]?)([A-Za-z])(?:\((\d+)\)|(\d+))?", text)
    if not m:
        raise FitsError(261, text)
    if m[3].upper() not in WIDTH:
        raise FitsError(262, text)
    return Tform(int(m[1] or 1), m[3].upper(), m[2].upper(), int(m[4] or m[5] or 0))


def parse_ascii_tform(text: str) -> tuple[str, int, int]:
    """(letter, width, decimals) of Aw, Iw, Fw.d, Ew.d, Dw.d."""
    m = re.fullmatch(r"\s*([A-Za-z])(\d+)(?:\.(\d+))?\s*", text)
    if not m:
        raise FitsError(261, text)
    letter, width, decimals = m[1].upper(), int(m[2]), int(m[3] or 0)
    if letter not in "AIFED":
        raise FitsError(262, text)
    if width < 1 or letter in "FED" and decimals >= width:
        raise FitsError(261, text)
    return letter, width, decimals


def ascii_starts(formats: list[str], space: int = 1) -> tuple[int, list[int]]:
    """(row width, first columns from 1) of fields with `space` blanks between."""
    at, out = 1, []
    for f in formats:
        out.append(at)
        at += parse_ascii_tform(f)[1] + space
    return max(at - 1 - space, 0), out


def binary_offsets(formats: list[str]) -> tuple[int, list[int]]:
    sizes = [parse_tform(f).nbytes for f in formats]
    return sum(sizes), [sum(sizes[:i]) for i in range(len(sizes))]


def decode_tdim(text: str) -> list[int]:
    m = re.fullmatch(r"\s*\(\s*(\d+(?:\s*,\s*\d+)*)\s*\)\s*", text)
    if not m:
        raise FitsError(263, text)
    dims = [int(x) for x in m[1].split(",")]
    if math.prod(dims) >= 1 << 63:
        raise FitsError(111, text)
    return dims


def format_tdim(dims: list[int]) -> str:
    if not dims or min(dims) < 0:
        raise FitsError(263)
    return "(" + ",".join(map(str, dims)) + ")"


@dataclass
class Column:
    name: str
    form: Tform | tuple[str, int, int]
    scale: float = 1.0
    zero: float = 0.0
    null: int | str | None = None
    offset: int = 0
    unit: str = ""
    dim: str = ""

    @property
    def kind(self) -> str:
        """The letter with the offset trick undone."""
        if isinstance(self.form, tuple):
            return self.form[0]
        if self.scale == 1:
            for letter, (base, zero) in STORED.items():
                if self.form.letter == base and self.zero == zero:
                    return letter
        return self.form.letter

    def arrow(self) -> pa.DataType:
        if isinstance(self.form, tuple):
            return {"A": pa.string(), "I": pa.int64()}.get(self.form[0], pa.float64()) if (self.scale, self.zero) == (1, 0) or self.form[0] == "A" else pa.float64()
        k = self.kind
        if k == "A":
            return pa.string()
        if k == "X":
            return pa.list_(pa.bool_())
        one = ARROW[k]
        if (self.scale != 1 or self.zero != 0) and k == self.form.letter and k in "BIJK":
            one = pa.float64()
        return pa.list_(one) if self.form.descriptor or self.form.repeat != 1 else one


def dims_of(c: Column) -> list[int]:
    """The axes of a column's cells by TDIM, or its repeat where there is none; axes that do not make up the repeat: status 263. Cells
    of variable length have no repeat to compare with."""
    if isinstance(c.form, tuple):  # a field of an ASCII table
        return [1]
    if not c.dim:
        return [max(c.form.repeat, 1)]
    dims = decode_tdim(c.dim)
    if not c.form.descriptor and math.prod(dims) != c.form.repeat:
        raise FitsError(263, c.name, c.dim)
    return dims


@dataclass
class Layout:
    kind: str  # BINTABLE or TABLE
    columns: list[Column]
    row_bytes: int
    rows: int
    data_start: int = 0
    heap: int = 0  # bytes from the start of the data
    heap_bytes: int = 0


def layout(h: Header, data_start: int = 0) -> Layout:
    """How a table's bytes are laid out. Blank names become _cN, repeated ones get _N."""
    ascii_ = h.get("XTENSION", "").strip() == "TABLE"
    n, width, rows = h.integer("TFIELDS"), h.integer("NAXIS1"), h.integer("NAXIS2")
    columns, at, seen = [], 0, set()
    for i in range(1, n + 1):
        name = (h.get(f"TTYPE{i}") or "").strip() or f"_c{i}"
        while name.lower() in seen:
            name += f"_{i}"
        seen.add(name.lower())
        text = h.string(f"TFORM{i}")
        form = parse_ascii_tform(text) if ascii_ else parse_tform(text)
        c = Column(name, form, float(h.get(f"TSCAL{i}", 1)), float(h.get(f"TZERO{i}", 0)), h.get(f"TNULL{i}"), unit=h.get(f"TUNIT{i}", "") or "", dim=h.get(f"TDIM{i}", "") or "")
        if ascii_:
            c.offset = h.integer(f"TBCOL{i}") - 1
        else:
            c.offset, at = at, at + form.nbytes
        columns.append(c)
    if not ascii_ and at != width:
        raise FitsError(241)
    heap = h.get("THEAP", width * rows)
    return Layout("TABLE" if ascii_ else "BINTABLE", columns, width, rows, data_start, heap, h.get("PCOUNT", 0))


def geometry(h: Header) -> int:
    """Bytes of the data unit without fill."""
    n = h.integer("NAXIS")
    if not n:
        return 0
    size = 1
    for i in range(1, n + 1):
        size *= h.integer(f"NAXIS{i}")
    return abs(h.integer("BITPIX")) // 8 * (size + h.get("PCOUNT", 0)) * h.get("GCOUNT", 1)


def ascii_number(field: bytes, decimals: int = 0) -> float | None:
    """A number as fields hold it: blanks within are skipped, D is an exponent, a comma is a point, decimals are implied
    where neither point nor exponent is written. Blank: 0. Anything else than a number: null."""
    s = field.decode("ascii", "replace").replace(" ", "").replace(",", ".").upper().replace("D", "E")
    if not s:
        return 0.0
    if m := re.fullmatch(r"([+-]?(?:\d+\.?\d*|\.\d+))([+-]\d+)", s):
        s = f"{m[1]}E{m[2]}"
    try:
        v = float(s)
    except ValueError:
        return None
    return v / 10**decimals if decimals and "." not in s and ("E" not in s or int(s.partition("E")[2] or 0) == 0) else v


def _ascii_numbers(text: pa.Array, decimals: int) -> pa.Array:
    """ascii_number() of each string: those written plainly at once, the others one by one."""
    t = pc.replace_substring(pc.utf8_trim(text, " "), "D", "E")
    plain = pc.match_substring_regex(t, r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    if decimals:
        plain = pc.and_(plain, pc.match_substring(t, "."))
    out = pc.if_else(plain, t, "0").cast(pa.float64())
    if pc.all(plain).as_py() in (True, None):
        return out
    values, odd = out.to_pylist(), np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    cells = text.take(pa.array(odd)).to_pylist()
    for i, x in zip(odd, cells, strict=True):
        values[i] = ascii_number(x.encode("ascii", "replace"), decimals)
    return pa.array(values, pa.float64())


def format_ascii(value, form: tuple[str, int, int]) -> bytes:
    letter, width, decimals = form
    if letter == "A":
        return str(value).encode("ascii", "replace")[:width].ljust(width)
    if letter == "I":
        text = str(int(value))
    elif value != value or abs(value) == float("inf"):
        raise FitsError(412)
    else:
        text = f"{value:.{decimals}f}" if letter == "F" else f"{value:.{decimals}E}"
        text = text.replace("E", "D") if letter == "D" else text
    if len(text) > width:
        raise FitsError(412, text)
    return text.rjust(width).encode()


def decode(lay: Layout, block: bytes, heap=None, names: list[str] | None = None) -> list[pa.Array]:
    """The columns `names` of whole rows. heap(offset, size) reads bytes of the heap."""
    n = len(block) // lay.row_bytes if lay.row_bytes else 0
    raw = np.frombuffer(block, np.uint8)[: n * lay.row_bytes].reshape(n, lay.row_bytes)
    by = {c.name: c for c in lay.columns}
    return [_decode(by[x], raw[:, by[x].offset :], n, heap) for x in (names or list(by))]


def _text(data: np.ndarray, size: np.ndarray, codec: str = "utf-8") -> pa.Array:
    """Strings that stand one after the other in data; bytes that are no text become U+FFFD."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    if len(data) and data.max() >= 128:
        if codec == "utf-8":
            out = pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
            try:
                out.validate(full=True)
            except pa.ArrowInvalid:
                pass
            else:
                return out
        return pa.array([data[x:y].tobytes().decode(codec, "replace") for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))


def _strings(cell: np.ndarray, nul: bool = True, codec: str = "utf-8") -> pa.Array:
    """Rows of fixed width up to their first NUL, without blanks at the end."""
    n, width = cell.shape
    if not width:
        return pa.array([""] * n, pa.string())
    place = np.arange(1, width + 1, dtype=np.int32)
    keep = cell != 32
    if nul and not cell.all():
        zero = cell == 0
        keep &= np.cumsum(zero, axis=1) == 0
    size = np.where(keep, place, 0).max(axis=1)
    return _text(cell[place[None, :] <= size[:, None]], size, codec)


def _cells_of(joined: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of variable length, cut like those of _strings()."""
    at = np.cumsum(size)
    full = size > 0
    if len(joined) and (not joined.all() or (joined[at[full] - 1] == 32).any()):
        cut = [bytes(x).split(b"\0", 1)[0].rstrip(b" ") for x in np.split(joined, at[:-1])]
        return _text(np.frombuffer(b"".join(cut), np.uint8), np.array([len(x) for x in cut], np.int64))
    return _text(joined, size)


def _gathered(heap, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of cells of the heap, one after the other: one read where they stand close together, else one for each."""
    full = np.flatnonzero(size > 0)
    if not len(full):
        return np.zeros(0, np.uint8)
    o, n = offset[full], size[full]
    low, total = int(o.min()), int(n.sum())
    span = int((o + n).max()) - low
    if o.min() < 0 or span > 2 * total + (1 << 20):
        return np.frombuffer(b"".join(heap(int(x), int(y)) for x, y in zip(o, n, strict=True)), np.uint8)
    data = np.frombuffer(heap(low, span), np.uint8)
    if span == total and (o[1:] == o[:-1] + n[:-1]).all():
        return data
    ends = np.cumsum(n)
    return data[np.arange(total) + np.repeat(o - low - ends + n, n)]


def unsigned(stored: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Signed numbers of 64 bits plus 2^63, as decimals."""
    whole = np.zeros((len(stored), 2), "<u8")
    whole[:, 0] = stored.view(np.uint64) ^ np.uint64(1 << 63)
    valid = None if mask is None else pa.py_buffer(np.packbits(~mask, bitorder="little"))
    return pa.Array.from_buffers(pa.decimal128(20, 0), len(stored), [valid, pa.py_buffer(whole)])


def signed(a: pa.Array) -> np.ndarray:
    """Decimals from 0 to 2^64 - 1 less 2^63; null is 2^63 less than 0. Others: status 412."""
    whole = a.cast(pa.decimal128(38, 0)).fill_null(0)
    half = np.frombuffer(whole.buffers()[1], "<u8")[2 * whole.offset : 2 * (whole.offset + len(whole))].reshape(-1, 2)
    if half[:, 1].any():
        raise FitsError(412)
    return (half[:, 0] ^ np.uint64(1 << 63)).view(np.int64).copy()


def _numbers(values: np.ndarray, c: Column) -> pa.Array:
    """Stored numbers as physical ones: integral offsets stay integral, null is TNULL."""
    k, base = c.kind, c.form.letter
    mask = (values == int(c.null)) if c.null is not None and base in "BIJK" else None
    if k in "CM":
        pair = values.reshape(-1, 2).astype(values.dtype.newbyteorder("="))
        return pa.StructArray.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["re", "im"])
    values = values.astype(values.dtype.newbyteorder("="))
    if k == "W":
        return unsigned(values, mask)
    if k in STORED:
        return pa.array(values.astype(np.int64) + int(c.zero), mask=mask).cast(ARROW[k])
    if c.scale != 1 or c.zero != 0:
        physical = values.astype(np.float64) * c.scale + c.zero
        return pa.array(physical, ARROW["E"] if base == "E" else pa.float64(), mask=mask) if base != "E" else pa.array(physical.astype(np.float32), mask=mask)
    return pa.array(values, mask=mask).cast(ARROW[base])


def _decode(c: Column, raw: np.ndarray, n: int, heap) -> pa.Array:
    if isinstance(c.form, tuple):
        letter, width, decimals = c.form
        cell = np.ascontiguousarray(raw[:, :width])
        text = _strings(cell, nul=False, codec="ascii")
        if letter == "A":
            return text
        values = _ascii_numbers(text, decimals)
        if c.null is not None and (null := str(c.null).strip()):
            values = pc.if_else(pc.starts_with(pc.utf8_ltrim(text, " "), null), pa.scalar(None, pa.float64()), values)
        if (c.scale, c.zero) != (1, 0):
            return pc.add(pc.multiply(values, c.scale), c.zero)
        return pc.round(values, round_mode="half_towards_infinity").cast(pa.int64()) if letter == "I" else values
    f = c.form
    cell = np.ascontiguousarray(raw[:, : f.nbytes])
    if f.descriptor:
        d = cell.view(">i4" if f.descriptor == "P" else ">i8").reshape(n, 2).astype(np.int64)
        unit = 1 if f.letter == "X" else WIDTH[f.letter]
        size = -(-d[:, 0] // 8) if f.letter == "X" else d[:, 0] * unit
        joined = _gathered(heap, d[:, 1], size)
        if f.letter == "A":
            return _cells_of(joined, size)
        if f.letter == "X":  # a cell starts at a byte
            ends = np.cumsum(d[:, 0])
            bit = np.arange(ends[-1] if n else 0) + np.repeat((np.cumsum(size) - size) * 8 - ends + d[:, 0], d[:, 0])
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.unpackbits(joined)[bit].astype(bool)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(d[:, 0])]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, _cells(joined, c))
    if f.letter == "A":
        return _strings(cell)
    if f.letter == "X":
        bits = np.unpackbits(cell, axis=1)[:, : f.repeat].astype(bool)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * f.repeat), pa.array(bits.ravel()))
    flat = _cells(cell.ravel(), c)
    return flat if f.repeat == 1 else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * f.repeat), flat)


def _cells(joined: np.ndarray, c: Column) -> pa.Array:
    if c.form.letter == "L":
        return pa.array(joined == ord("T"), mask=(joined != ord("T")) & (joined != ord("F")))
    return _numbers(joined.view(DTYPE[c.form.letter]), c)


def encode(columns: list[Column], batch: pa.RecordBatch, heap: bytearray) -> bytes:
    """Rows of a binary table; cells of variable length go to the heap, whose offsets count from its start."""
    n = batch.num_rows
    rows = np.zeros((n, sum(c.form.nbytes for c in columns)), np.uint8)
    for c, a in zip(columns, batch.columns, strict=True):
        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        rows[:, c.offset : c.offset + c.form.nbytes] = _encode(c, a, n, heap)
    return rows.tobytes()


def _parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte, size) of strings; null is empty."""
    a = a.cast(pa.binary()) if a.type != pa.binary() else a
    a = a.fill_null(b"") if a.null_count else a
    _, at, data = a.buffers()
    at = np.frombuffer(at, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _fixed(data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int, right: bool = False) -> np.ndarray:
    """Strings as rows of `width` bytes, filled with blanks."""
    out = np.full((len(size), width), 32, np.uint8)
    before = np.cumsum(size) - size
    k = np.arange(size.sum()) - np.repeat(before, size)
    start = np.arange(len(size)) * width + (width - size if right else 0)
    out.ravel()[k + np.repeat(start, size)] = data[k + np.repeat(first, size)]
    return out


def _bits(flat: np.ndarray, size: np.ndarray, start: np.ndarray, nbytes: int) -> np.ndarray:
    """Bytes with each cell's bits from its first byte `start` on."""
    bits = np.zeros(nbytes * 8, bool)
    bits[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start * 8, size)] = flat
    return np.packbits(bits)


def _encode(c: Column, a: pa.Array, n: int, heap: bytearray) -> np.ndarray:
    f = c.form
    if f.descriptor:
        d = np.zeros((n, 2), ">i4" if f.descriptor == "P" else ">i8")
        if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
            count = pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = a.flatten()
            if f.letter == "X":
                size = -(-count // 8)
                stored = _bits(flat.fill_null(False).to_numpy(zero_copy_only=False), count, np.cumsum(size) - size, int(size.sum()))
            else:
                size = count * WIDTH[f.letter]
                stored = _stored(c, flat.cast(ARROW[c.kind]))
            data = stored.tobytes()
        else:
            raw, first, size = _parts(a)
            data = raw[first[0] : first[-1] + size[-1]].tobytes() if n else b""
            count = size // WIDTH[f.letter]
        offset = len(heap) + np.cumsum(size) - size
        if f.descriptor == "P" and n and offset[-1] + size[-1] >= 1 << 31:
            raise FitsError(264, c.name)
        d[:, 0], d[:, 1] = count, np.where(count > 0, offset, 0)
        heap += data
        return d.view(np.uint8).reshape(n, -1)
    if f.letter == "A":
        data, first, size = _parts(a)
        for i in np.flatnonzero(size > f.repeat):  # a character is not cut in two
            size[i] = len(data[first[i] : first[i] + f.repeat].tobytes().decode("utf-8", "ignore").encode())
        return _fixed(data, first, size, f.repeat)
    if f.letter == "X":
        count = pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(count) and count.max() > f.repeat:
            raise FitsError(308, c.name)
        return _bits(a.flatten().fill_null(False).to_numpy(zero_copy_only=False), count, np.arange(n) * f.nbytes, n * f.nbytes).reshape(n, f.nbytes)
    if f.repeat != 1:
        flat = a.flatten() if a.null_count == 0 else None
        if flat is None or len(flat) != n * f.repeat:
            raise FitsError(308, c.name)
        return _stored(c, flat).view(np.uint8).reshape(n, -1)
    return _stored(c, a).view(np.uint8).reshape(n, -1)


def encode_ascii(columns: list[Column], batch: pa.RecordBatch) -> bytes:
    """Rows of an ASCII table; a null number without TNULL: status 314."""
    width = max(c.offset + c.form[1] for c in columns)
    out = np.full((batch.num_rows, width), 32, np.uint8)
    for c, a in zip(columns, batch.columns, strict=True):
        letter, wide, decimals = c.form
        if letter == "A":
            data, first, size = _parts(pa.array([str(c.null or "") if x is None else str(x) for x in a.to_pylist()] if a.type != pa.string() else a.fill_null(str(c.null or ""))))
            if len(data) and data.max() >= 128:
                data, first, size = _parts(pa.array([x.as_py().encode("ascii", "replace") for x in a.fill_null(str(c.null or ""))], pa.binary()))
            cells = _fixed(data, first, np.minimum(size, wide), wide)
        else:
            nulls = np.asarray(a.is_null())
            if nulls.any() and c.null is None:
                raise FitsError(314, c.name)
            values = a.fill_null(0).to_pylist()
            if (c.scale, c.zero) != (1, 0):
                values = [(x - c.zero) / c.scale for x in values]
            if letter == "I":
                text = [str(int(x)) for x in values]
            else:
                numbers = np.array(values, np.float64)
                if not np.isfinite(numbers).all():
                    raise FitsError(412, c.name)
                form = f"%.{decimals}f" if letter == "F" else f"%.{decimals}E"
                text = [form % x for x in numbers.tolist()]
                text = [x.replace("E", "D") for x in text] if letter == "D" else text
            data, first, size = _parts(pa.array(text, pa.string()))
            if len(size) and size.max() > wide:
                raise FitsError(412, c.name)
            cells = _fixed(data, first, size, wide, right=True)
            if nulls.any():
                null = str(c.null).encode().ljust(wide)[:wide]
                cells[nulls] = np.frombuffer(null, np.uint8)
        out[:, c.offset : c.offset + wide] = cells
    return out.tobytes()


def _stored(c: Column, a: pa.Array) -> np.ndarray:
    base, k = c.form.letter, c.kind
    if base == "L":
        out = np.where(a.fill_null(False).to_numpy(zero_copy_only=False), ord("T"), ord("F")).astype(np.uint8)
        out[np.asarray(a.is_null())] = 0
        return out
    if base == "A":
        return np.frombuffer(b"".join(x.encode()[:1].ljust(1) for x in a.to_pylist()), np.uint8)
    if base in "CM":
        return np.column_stack([a.field(0).to_numpy(zero_copy_only=False), a.field(1).to_numpy(zero_copy_only=False)]).astype(DTYPE[base]).ravel()
    nulls = np.asarray(a.is_null())
    if base in "ED":
        return a.to_numpy(zero_copy_only=False).astype(np.float64).astype(DTYPE[base])  # null becomes NaN
    if nulls.any() and c.null is None:
        raise FitsError(314, c.name)
    if k == "W":
        values = signed(a)
    else:
        filled = a.fill_null(0).to_numpy(zero_copy_only=False)
        if c.scale != 1 or (c.zero != 0 and k == base):
            if not c.scale:
                raise FitsError(322, c.name)
            x = (filled.astype(np.float64) - c.zero) / c.scale
            filled = np.sign(x) * np.floor(np.abs(x) + 0.5)
        values = filled.astype(np.int64) - (int(c.zero) if k in STORED else 0)
    limits = np.iinfo(np.dtype(DTYPE[base]).newbyteorder("="))
    if len(values) and (values.min() < limits.min or values.max() > limits.max):
        raise FitsError(412, c.name)
    values[nulls] = int(c.null) if c.null is not None else 0
    return values.astype(DTYPE[base])


def table_header(columns: list[Column], rows: int, heap_bytes: int = 0, extname: str = "") -> Header:
    """Of a binary table, in the order that readers expect."""
    h = Header()
    h.write("XTENSION", "BINTABLE", "binary table extension").write("BITPIX", 8, "8-bit bytes").write("NAXIS", 2, "2-dimensional table")
    h.write("NAXIS1", sum(c.form.nbytes for c in columns), "width of table in bytes").write("NAXIS2", rows, "number of rows in table")
    h.write("PCOUNT", heap_bytes, "size of special data area").write("GCOUNT", 1, "one data group").write("TFIELDS", len(columns), "number of fields in each row")
    for i, c in enumerate(columns, 1):
        h.write(f"TTYPE{i}", c.name, f"label for field {i:3d}").write(f"TFORM{i}", str(c.form), "data format of field")
        for key, value in ((f"TUNIT{i}", c.unit), (f"TDIM{i}", c.dim)):
            if value:
                h.write(key, value)
        if c.scale != 1 or c.kind in STORED:
            h.write(f"TSCAL{i}", int(c.scale) if c.scale == int(c.scale) else c.scale)
        if c.zero:
            h.write(f"TZERO{i}", int(c.zero) if c.zero == int(c.zero) else c.zero)
        if c.null is not None:
            h.write(f"TNULL{i}", c.null)
    if extname:
        h.write("EXTNAME", extname, "name of this binary table extension")
    return h


def ascii_header(columns: list[Column], rows: int, extname: str = "") -> Header:
    h = Header()
    width = max((c.offset + c.form[1] for c in columns), default=0)
    h.write("XTENSION", "TABLE", "ASCII table extension").write("BITPIX", 8, "8-bit ASCII characters").write("NAXIS", 2, "2-dimensional ASCII table")
    h.write("NAXIS1", width, "width of table in characters").write("NAXIS2", rows, "number of rows in table").write("PCOUNT", 0, "no group parameters (required keyword)")
    h.write("GCOUNT", 1, "one data group (required keyword)").write("TFIELDS", len(columns), "number of fields in each row")
    for i, c in enumerate(columns, 1):
        letter, w, d = c.form
        h.write(f"TTYPE{i}", c.name, f"label for field {i:3d}").write(f"TBCOL{i}", c.offset + 1, f"beginning column of field {i:3d}")
        h.write(f"TFORM{i}", f"{letter}{w}" + (f".{d}" if letter in "FED" else ""), "Fortran-77 format of field")
        if c.unit:
            h.write(f"TUNIT{i}", c.unit, "physical unit of field")
        if c.null is not None:
            h.write(f"TNULL{i}", str(c.null), "null value")
    if extname:
        h.write("EXTNAME", extname, "name of this ASCII table extension")
    return h


def empty_primary() -> bytes:
    h = Header()
    h.write("SIMPLE", True, "file does conform to FITS standard").write("BITPIX", 8, "number of bits per data pixel").write("NAXIS", 0, "number of data axes").write("EXTEND", True, "FITS dataset may contain extensions")
    h.comment("  FITS (Flexible Image Transport System) format is defined in 'Astronomy").comment("  and Astrophysics', volume 376, page 359; bibcode: 2001A&A...376..359H")
    return h.to_bytes()


def padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % 2880)
