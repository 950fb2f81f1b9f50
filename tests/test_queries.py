"""Each registered query against its SQL, on the small tables; and the table round trips that SQL can't tell."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from skyframe.operators import edits
from skyframe.plans import catalogue
from skyframe.sources import fits
from skyframe.streaming.landing import stream_fits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    norm = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(norm, r)) for r in frame.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE_SQL:
        assert rows(got) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())
    else:
        assert len(got)
        assert name != "quantize_roundtrip" or got["close"].all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_headers_checksum_and_surgery(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/nation.parquet")
    path = str(tmp_path / "n.fits")
    fits.write_fits(d, path, single=True, checksum=True, extname="NATION", tform={"n_name": "25A"})
    heads = {(r["hdu"], r["keyword"]): r["value"] for r in fits.fits_headers(spark, path).collect()}
    assert heads[2, "EXTNAME"] == "'NATION  '" and heads[2, "NAXIS2"] == "25"
    assert [r["type"] for r in fits.fits_hdus(spark, path).orderBy("hdu").collect()] == ["image", "binary"]
    assert fits.read_fits(spark, path, extname="nation").count() == 25
    from skyframe.functions import checksum

    header, data = edits.Container.open(path).units[1]
    assert checksum.verify(header, header.to_bytes(), data) == (1, 1)
    assert fits.read_fits(spark, path, raw="true").count() == 25
    with pytest.raises(Exception, match="105"):
        fits.write_fits(d, path, single=True)


def test_stream(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/nation.parquet")
    fits.write_fits(d, str(tmp_path / "in"), tform={"n_name": "25A"})
    q = stream_fits(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("landed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("landed").count() == 25
