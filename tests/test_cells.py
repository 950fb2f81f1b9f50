"""Cells of tables, encoded and decoded at once, against plain versions one cell at a time."""

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyframe.format import tables as tb
from skyframe.format.status import FitsError
from skyframe.sources.fits import read_fits, write_fits


def round_trip(form, array, kind=None):
    f = tb.parse_tform(form)
    letter, zero = tb.STORED.get(f.letter, (f.letter, 0))
    f.letter = letter
    c = tb.Column("c", f, 1, zero, None, 0)
    heap = bytearray()
    data = tb.encode([c], pa.RecordBatch.from_arrays([array], names=["c"]), heap)
    lay = tb.Layout("BINTABLE", [c], f.nbytes, len(array))
    return data, bytes(heap), tb.decode(lay, data, lambda o, n: bytes(heap[o : o + n]))[0]


TEXTS = ["", "a", "b ", "  c", "été", "naïve café", "x" * 9, None, "a\0b", "ñ" * 6, " ", "日本語"]


@pytest.mark.parametrize("width", [1, 5, 9, 20])
def test_fixed_strings(width):
    a = pa.array(["skipped", *TEXTS], pa.string()).slice(1)  # an array that starts within its buffers
    data, _, back = round_trip(f"{width}A", a)
    want = [(x or "").encode()[:width].decode("utf-8", "ignore").encode().ljust(width) for x in TEXTS]
    assert data == b"".join(want)
    assert back.to_pylist() == [x.split(b"\0")[0].rstrip(b" ").decode() for x in want]
    broken = tb._strings(np.frombuffer(b"ab\xff c\xc3  ", np.uint8).reshape(2, 4))
    assert broken.to_pylist() == [b"ab\xff".decode("utf-8", "replace"), b"c\xc3".decode("utf-8", "replace")]


@pytest.mark.parametrize("form", ["1PA", "1QA"])
def test_variable_strings(form):
    a = pa.array(["skipped", *TEXTS], pa.string()).slice(1)
    _, heap, back = round_trip(form, a)
    assert heap == b"".join((x or "").encode() for x in TEXTS)
    assert back.to_pylist() == [(x or "").split("\0")[0].rstrip(" ") for x in TEXTS]
    plain = [x for x in TEXTS if x and x == x.rstrip(" ") and "\0" not in x]
    assert round_trip(form, pa.array(plain))[2].to_pylist() == plain


def test_lists_and_bits():
    lists = [[1, 2, 3], [], None, [-5], list(range(40))]
    assert round_trip("1PJ", pa.array([[9], *lists], pa.list_(pa.int32())).slice(1))[2].to_pylist() == [x or [] for x in lists]
    bits = [[True], [], [False] * 8 + [True], None, [True, False, True]]
    a = pa.array([[True], *bits], pa.list_(pa.bool_())).slice(1)
    assert round_trip("1PX", a)[2].to_pylist() == [x or [] for x in bits]
    data, _, back = round_trip("10X", a)
    assert data == b"".join(np.packbits(np.array(([*(x or [])] + [False] * 10)[:10], bool)).tobytes() for x in bits)
    assert back.to_pylist() == [([*(x or [])] + [False] * 10)[:10] for x in bits]
    with pytest.raises(FitsError, match="308"):
        round_trip("2X", a)
    assert round_trip("1L", pa.array([True, None, False]))[0] == b"T\0F"


def test_unsigned_extremes():
    values = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
    data, _, back = round_trip("1W", pa.array([Decimal(v) for v in values], pa.decimal128(20, 0)))
    assert data == b"".join((v - (1 << 63)).to_bytes(8, "big", signed=True) for v in values) and back.to_pylist() == [Decimal(v) for v in values]
    with pytest.raises(FitsError, match="412"):
        round_trip("1W", pa.array([Decimal(1 << 64)], pa.decimal128(21, 0)))


def test_heap_read_at_once_or_cell_by_cell():
    heap = bytes(range(200)) + bytes(5 << 20) + b"far away"
    asked = []

    def read(o, n):
        asked.append((o, n))
        return heap[o : o + n]

    offset, size = np.array([10, 0, 3, 100]), np.array([5, 0, 4, 2])
    assert tb._gathered(read, offset, size).tobytes() == heap[10:15] + heap[3:7] + heap[100:102] and len(asked) == 1
    assert tb._gathered(read, np.array([0, len(heap) - 8]), np.array([2, 8])).tobytes() == heap[:2] + b"far away" and len(asked) == 3


def test_ascii_fields():
    fields = ["  1.50", "1.5E+2", " 1.5D2", "   15 ", "  -7", "+3", "1 2", "1,5", "", "x", "1.5+3", ".5", "5."]
    for decimals in (0, 2):
        assert tb.ascii_number(b"-7") == -7 and tb.ascii_number(b"-1.5-3") == -0.0015
        assert tb._ascii_numbers(pa.array(fields), decimals).to_pylist() == [tb.ascii_number(x.encode(), decimals) for x in fields]
    columns = [tb.Column("a", ("A", 6, 0), 1, 0, None, 0), tb.Column("i", ("I", 5, 0), 1, 0, "none", 7), tb.Column("f", ("F", 8, 2), 1, 0, None, 13), tb.Column("d", ("D", 14, 5), 1, 0, None, 22)]
    text, whole, real = ["one", "zwölf monate", "", None], [1, -22, None, 99999], [1.25, -0.005, 1e4, 0.0]
    batch = pa.RecordBatch.from_arrays([pa.array(text), pa.array(whole, pa.int32()), pa.array(real), pa.array(real)], names=list("aifd"))
    want = b"".join(
        b" ".join([tb.format_ascii(t or "", ("A", 6, 0)), b"none " if i is None else tb.format_ascii(i, ("I", 5, 0)), tb.format_ascii(x, ("F", 8, 2)), tb.format_ascii(x, ("D", 14, 5))])
        for t, i, x in zip(text, whole, real, strict=True)
    )
    assert tb.encode_ascii(columns, batch) == want
    back = tb.decode(tb.Layout("TABLE", columns, 36, 4), want)
    assert [x.to_pylist() for x in back] == [["one", "zw?lf", "", ""], whole, [float(f"{x:.2f}") for x in real], [float(f"{x:.5E}") for x in real]]
    for bad, code in ((pa.array([123456]), "412"), (pa.array([None], pa.int32()), "314")):
        with pytest.raises(FitsError, match=code):
            tb.encode_ascii([tb.Column("i", ("I", 5, 0), 1, 0, None, 0)], pa.RecordBatch.from_arrays([bad], names=["i"]))


@pytest.mark.parametrize(
    "sql, code", [("array('a')", 410), ("array(array(1))", 410), ("cast(1.25 as decimal(10, 2))", 410), ("date'2020-01-02'", 410), ("map(1, 2)", 410)]
)
def test_types_without_cells(spark, tmp_path, sql, code):
    with pytest.raises(Exception, match=str(code)):
        write_fits(spark.sql(f"select {sql} as x"), str(tmp_path / "t"))
    assert not list(tmp_path.iterdir())


def test_most_columns(spark, tmp_path):
    d = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(1000)])
    with pytest.raises(Exception, match="216"):
        write_fits(d, str(tmp_path / "t"))
    write_fits(d.drop("c3"), str(tmp_path / "t"))
    assert read_fits(spark, str(tmp_path / "t")).select("c999").first()[0] == 999
