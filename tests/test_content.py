"""Files that lie in a binary column, and containers from and to streams."""

import gzip
import io
import sys
from types import SimpleNamespace

import pytest

from skyframe.format.header import Header
from skyframe.format.status import FitsError
from skyframe.operators import edits
from skyframe.sources import fits


def image(name: str, pixels: bytes) -> bytes:
    box = edits.Container()
    h = Header().write("SIMPLE", True).write("BITPIX", 8).write("NAXIS", 1).write("NAXIS1", len(pixels)).write("OBJECT", name)
    box.units[0] = (h, pixels)
    return box.to_bytes()


def test_content(spark):
    rows = [("a", image("a", b"\1\2\3")), ("b", gzip.compress(image("b", b"\4"))), ("c", None)]
    d = spark.createDataFrame(rows, "name string, content binary")
    want = [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 4)]
    assert sorted(map(tuple, fits.read_fits_content(d, keep=["name"]).collect())) == want
    assert fits.read_fits_content(d.where("name = 'b'")).columns == ["_pix", "value"]

    def edit(box):
        box.units[0][0].update("OBJECT", "x")

    done = edits.map_files(d, edit)
    assert sorted(map(tuple, fits.read_fits_content(done, keep=["name"]).collect())) == want
    got = {r["name"]: r["content"] for r in done.collect()}
    assert got["c"] is None and edits.Container(bytes(got["b"])).units[0][0].get("OBJECT") == "x"
    with pytest.raises(FitsError):
        fits.read_fits_content(d.where("name = 'c'"))


def test_table_content(spark, tmp_path):
    d = spark.range(500).selectExpr("id", "cast(id as string) as s")
    fits.write_fits(d.repartition(3), str(tmp_path / "t"), compression="gzip")
    some = spark.read.format("binaryFile").load(str(tmp_path / "t"))
    got = fits.read_fits_content(some, keep=["path"], rowid=True, columns=["s"])
    assert got.columns == ["path", "_row", "s"] and got.select("path", "_row").distinct().count() == 500
    assert sorted(r["s"] for r in got.collect()) == sorted(str(i) for i in range(500))


def test_streams_and_files(monkeypatch, tmp_path):
    data = image("a", b"\1\2")
    out = io.BytesIO()
    monkeypatch.setattr(sys, "stdin", SimpleNamespace(buffer=io.BytesIO(gzip.compress(data))))
    monkeypatch.setattr(sys, "stdout", SimpleNamespace(buffer=out))
    box = edits.Container.open("-")
    box.save("-")
    assert out.getvalue() == data
    path = str(tmp_path / "a.fits.gz")
    box.save(path)
    with pytest.raises(FitsError):
        box.save(path)
    box.save("!" + path)
    assert edits.Container.open(path).to_bytes() == data
