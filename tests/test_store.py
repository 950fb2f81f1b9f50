"""Tables written to stores through Arrow are those that mounted folders get."""

import pytest
from pyspark.sql import functions as F

from skyframe.format import tables
from skyframe.functions import checksum
from skyframe.operators import edits
from skyframe.sources import files
from skyframe.sources.fits import read_fits, write_fits


def frame(spark):
    return spark.range(3000).repartition(3).select("id", F.concat(F.lit("n"), "id").alias("s"), F.expr("sequence(0L, id % 5)").alias("a"))


@pytest.mark.parametrize("options", [{}, {"single": True}, {"compression": "gzip"}, {"single": True, "compression": "gzip"}])
def test_same_as_mounted(spark, tmp_path, options):
    d = frame(spark)
    for mounted in (True, False):
        path = str(tmp_path / f"t{mounted}")
        write_fits(d, path, mounted=mounted, checksum=True, **options)
        assert sorted(read_fits(spark, path).collect()) == sorted(d.collect())
        for name in files.list_files(path):
            header, data = edits.Container.open(name).units[1]
            assert checksum.verify(header, header.to_bytes(), tables.padded(data)) == (1, 1)
        with pytest.raises(Exception, match="105"):
            write_fits(d, path, mounted=mounted, **options)
        write_fits(d.limit(5), "!" + path, mounted=mounted, **options)
        assert read_fits(spark, path).count() == 5
        write_fits(d.limit(0), "!" + path, mounted=mounted, **options)
        assert read_fits(spark, path).count() == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["tFalse", "tTrue"]


def test_ascii(spark, tmp_path):
    d = spark.range(100).selectExpr("id", "cast(id as string) as s")
    write_fits(d, f"file://{tmp_path}/t", mounted=False, kind="ascii", checksum=True)
    assert sorted(read_fits(spark, f"file://{tmp_path}/t").collect()) == sorted(d.collect())


def test_places():
    assert isinstance(files.place("/a/b"), files.Mounted) and isinstance(files.place("file:///a/b"), files.Mounted)
    store = files.place("mock:///a/b")
    assert isinstance(store, files.Store) and store.path.strip("/") == "a/b"


def test_bounds_outside(spark, tmp_path):
    """Nothing is left to read."""
    path = str(tmp_path / "t")
    write_fits(spark.range(10), path, single=True)
    assert read_fits(spark, path, rowid=True).where("_row > 10").count() == 0
    assert read_fits(spark, path, firstrow=20).count() == 0
