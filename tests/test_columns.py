"""Axes and units of columns, HDUs put between others, positions in headers, messages."""

import threading

import pytest

from skyframe.format import tables
from skyframe.format.header import Header
from skyframe.format.status import MESSAGES, FitsError
from skyframe.operators import edits
from skyframe.sources.fits import fits_columns, fits_hdus, read_fits, write_fits


def test_axes(spark, tmp_path):
    d = spark.range(4).selectExpr("id", "array(1, 2, 3, 4, 5, 6) as v")
    path = str(tmp_path / "a")
    write_fits(d, path, single=True, tform={"v": "6J"}, tdim={"v": "(2,3)"}, tunit={"id": "s"})
    back = read_fits(spark, path)
    assert back.schema["v"].metadata == {"tdim": "(2,3)"} and back.schema["id"].metadata == {"tunit": "s"}
    write_fits(back, path + "2", single=True, tform={"v": "6J"})
    assert [(r["unit"], r["dims"]) for r in fits_columns(spark, path + "2").orderBy("pos").collect()] == [("s", [1]), (None, [2, 3])]
    # axes of the DataFrame that the new format can't have are left out, given ones are an error
    write_fits(back.selectExpr("slice(v, 1, 4) as v").withMetadata("v", {"tdim": "(2,3)"}), path + "3", single=True, tform={"v": "4J"})
    assert read_fits(spark, path + "3").schema["v"].metadata == {}
    with pytest.raises(Exception, match="263"):
        write_fits(d, path + "4", single=True, tform={"v": "6J"}, tdim={"v": "(2,2)"})
    column = tables.Column("x", tables.parse_tform("6J"), dim="(7)")
    with pytest.raises(FitsError):
        tables.dims_of(column)
    column.dim = ""
    assert tables.dims_of(column) == [6] and tables.dims_of(tables.Column("x", ("A", 5, 0))) == [1]


def test_insert(spark, tmp_path):
    path = str(tmp_path / "i.fits")
    box = edits.Container()
    box.insert_table(1, ["a", "b"], ["1J", "3A"], 2, ["m", ""], "LAST")
    box.insert_table(1, ["a"], ["I6"], 3, ascii_=True)
    box.insert_image(1, "u16", [2, 2])
    box.save(path)
    assert [r["type"] for r in fits_hdus(spark, path).orderBy("hdu").collect()] == ["image", "image", "ascii", "binary"]
    assert [r["value"] for r in read_fits(spark, path, hdu=2).collect()] == [0] * 4
    assert read_fits(spark, path, hdu=3).count() == 3
    assert [tuple(r) for r in read_fits(spark, path, extname="last").collect()] == [(0, "")] * 2
    with pytest.raises(FitsError):
        box.insert_table(1, ["a"], ["1J"], -1)


def test_positions():
    h = Header().write("A", 1, "one").write("B", "two")
    assert h.keyn(1) == ("A", "1", "one") and [c[:1] for c in h] == ["A", "B"]
    with pytest.raises(FitsError):
        h.keyn(3)


def test_messages():
    MESSAGES.clear()
    MESSAGES.push("first")
    MESSAGES.push("second")
    seen = []
    t = threading.Thread(target=lambda: seen.append(MESSAGES.pop()))
    t.start()
    t.join()
    assert seen == [None] and [MESSAGES.pop() for _ in range(3)] == ["first", "second", None]
