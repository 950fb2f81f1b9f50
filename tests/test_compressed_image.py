"""Compressed images give back what was written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.format import tables
from skyframe.format.status import FitsError
from skyframe.format.zimage import ZImage
from skyframe.functions import checksum
from skyframe.operators import edits
from skyframe.sources.compressed import write_compressed_image, write_compressed_pixels
from skyframe.sources.fits import read_fits, write_image


def image(spark, n, expr="cast(pmod(id * 37, 251) as int)"):
    return spark.range(n).selectExpr("id + 1 as _pix", f"{expr} as value")


def back(spark, path, **options):
    return {r["_pix"]: r["value"] for r in read_fits(spark, str(path), hdu=2, **options).collect()}


@pytest.mark.parametrize("name", ["RICE_1", "GZIP_1", "PLIO_1", "HCOMPRESS_1", "NOCOMPRESS"])
@pytest.mark.parametrize("kind", ["u8", "i16", "u32"])
def test_integers(spark, tmp_path, name, kind):
    if (name, kind) == ("PLIO_1", "u32"):
        pytest.skip("PLIO_1 takes 0 to 2^24 - 1")
    d = image(spark, 23 * 17 * 2)
    write_compressed_image(d, str(tmp_path / "a.fits"), [23, 17, 2], kind, name, tile=[10, 5, 1], checksum=True)
    assert back(spark, tmp_path / "a.fits") == {r["_pix"]: r["value"] for r in d.collect()}


def test_floats(spark, tmp_path):
    d = image(spark, 64 * 30, "if(id < 64, 7.5D, if(id = 700, double('nan'), sin(id) * 100 + id))")
    want = {r["_pix"]: r["value"] for r in d.collect()}
    for method in (0, 1, 2):
        path = tmp_path / f"m{method}.fits"
        write_compressed_image(d, str(path), [64, 30], "f64", "RICE_1", level=-0.01, method=method)
        got = back(spark, path)
        assert got.keys() == want.keys() and np.isnan(got[701])
        assert all(abs(got[p] - want[p]) <= 0.0051 for p in want if p != 701)
    with pytest.raises(FitsError):
        write_compressed_image(d, str(tmp_path / "x.fits"), [64, 30], "f32", "RICE_1", level=0)


def test_slices_and_errors(spark, tmp_path):
    path = str(tmp_path / "a.fits")
    write_compressed_image(image(spark, 40 * 50), path, [40, 50], "i32")
    some = read_fits(spark, path, hdu=2, partbytes=1000).where("_pix between 401 and 480")
    assert some.count() == 80 and some.rdd.getNumPartitions() == 1
    assert ZImage(16, [40, 50], [40, 3]).rows_of(401, 480) == (4, 4)
    assert ZImage(16, [40, 50], [10, 3]).rows_of(401, 480) == (1, 68)
    with pytest.raises(FitsError):
        write_compressed_image(image(spark, 40 * 49), str(tmp_path / "b.fits"), [40, 50], "i32")
    with pytest.raises(Exception, match="308"):
        write_compressed_image(image(spark, 2000).where(F.col("_pix") != 7), str(tmp_path / "c.fits"), [40, 50], "i32")


@pytest.mark.parametrize("name", ["RICE_1", "GZIP_2", "PLIO_1", "HCOMPRESS_1"])
def test_some_pixels(spark, tmp_path, name):
    """Pixels of a few tiles are written anew; other tiles keep their bytes, other HDUs and cards stay, and the checksums are right."""
    path = str(tmp_path / "a.fits")
    d = image(spark, 46 * 34)
    write_compressed_image(d, path, [46, 34], "i16" if name == "PLIO_1" else "u16", name, tile=[10, 5], checksum=True)
    write_image(d, path, [46, 34], "i16", append=True)
    before = {r["tile"]: bytes(r["data"]) for r in read_fits(spark, path, hdu=2, tiles=True).collect()}
    some = d.where("_pix <= 3 or _pix between 60 and 62").withColumn("value", F.col("value") + 300)
    write_compressed_pixels(some, path)
    want = {r["_pix"]: r["value"] for r in d.collect()}
    assert {r["_pix"]: r["value"] for r in read_fits(spark, path, hdu=3).collect()} == want
    want |= {r["_pix"]: r["value"] for r in some.collect()}
    assert back(spark, path) == want
    after = {r["tile"]: bytes(r["data"]) for r in read_fits(spark, path, hdu=2, tiles=True).collect()}
    assert {t for t in after if after[t] != before[t]} == {1, 2}
    header, data = edits.Container.open(path).units[1]
    assert checksum.verify(header, header.to_bytes(), tables.padded(data)) == (1, 1)
    with pytest.raises(Exception, match="308"):
        write_compressed_pixels(image(spark, 46 * 34 + 1), path)
    with pytest.raises(Exception, match="314"):
        write_compressed_pixels(image(spark, 1, "cast(null as int)"), path)
    with pytest.raises(FitsError):
        write_compressed_pixels(d, path, 3)
    assert back(spark, path) == want and len(list(tmp_path.iterdir())) == 1


def test_some_float_pixels(spark, tmp_path):
    path = str(tmp_path / "f.fits")
    d = image(spark, 64 * 30, "if(id < 64, 7.5D, sin(id) * 100 + id)")
    write_compressed_image(d, path, [64, 30], "f32", level=-0.01)
    some = spark.createDataFrame([(3, -5.0), (70, None)], "_pix long, value double")
    write_compressed_pixels(some, path, level=-0.01)
    want = {r["_pix"]: r["value"] for r in d.collect()} | {3: -5.0}
    got = back(spark, path)
    assert np.isnan(got[70]) and all(abs(got[p] - want[p]) <= 0.0101 for p in want if p != 70)
