"""Cards, headers, formats and checksums against values worked out by hand or published."""

import numpy as np
import pytest

from skyframe.codecs import tiles as codec
from skyframe.format import cards as C
from skyframe.format import tables as tb
from skyframe.format.header import Header
from skyframe.format.status import FitsError, text
from skyframe.functions import checksum


def test_cards():
    assert C.make("NAXIS", "2", "axes") == "NAXIS   =                    2 / axes"
    assert C.make("OBJECT", C.quote("M31")).rstrip() == "OBJECT  = 'M31     '"
    assert C.parse(C.make("OBJECT", C.quote("it's"), "who")) == ("'it''s   '", "who")
    assert C.unquote("'it''s   '") == "it's"
    assert C.keyword(C.make("long keyword", "1")) == "long keyword"
    assert C.parse("COMMENT  hello") == ("", " hello")
    for name in ("A=B", "LOW=ER"):
        with pytest.raises(FitsError) as e:
            C.make(name, "1")
        assert e.value.status == 207
    C.test_keyword("DATE-OBS")
    with pytest.raises(FitsError):
        C.test_keyword("date")


@pytest.mark.parametrize("card,code", [("SIMPLE  =", 10), ("ZTILE1  =", 20), ("BZERO   =", 30), ("TNULL4  =", 40), ("TDIM12  =", 50), ("TLMIN1  =", 60), ("BUNIT   =", 70), ("TDISP3  =", 80), ("EXTVER  =", 90), ("DATASUM =", 100), ("TCRVL3  =", 110), ("RADESYS =", 120), ("HISTORY x", 130), ("CONTINUE  'x'", 140), ("TELESCOP=", 150)])
def test_classes(card, code):
    assert C.key_class(card) == code


def test_header_edits():
    h = Header().write("A", 1, "one").write("B", "x").write("C", True).write("D", 2.5, decimals=3).write("Z", 1 + 2j, decimals=2)
    assert [h.get(k) for k in "ABCDZ"] == [1, "x", True, 2.5, 1 + 2j]
    h.update("A", 7).modify("B", "it's").rename("C", "CC").set_unit("A", "km")
    assert (h.get("A"), h.get("B"), h.get("CC"), h.unit("A"), h.raw("A")[1]) == (7, "it's", True, "km", "[km] one")
    h.delete("D").write_keys("K", [3, 4, 5])
    assert h.keys("K") == [3, 4, 5] and not h.has("D")
    with pytest.raises(FitsError) as e:
        h.modify("NONE", 1)
    assert e.value.status == 202
    long = "it's " * 60
    h.write_long("LONGKEY", long.strip())
    assert h.get("LONGKEY") == long.strip()
    assert C.keyword(h.find(["k*"], ["K1"])) == "K2"
    h.template(["-K1", "-K2 K9", "NEW = 5 / five", "NAME hello", "COMMENT hi", "END", "NOT 1"])
    assert (h.has("K1"), h.get("K9"), h.get("NEW"), h.get("NAME"), h.has("NOT")) == (False, 4, 5, "hello", False)
    back, size = Header.parse(h.to_bytes())
    assert back.cards == h.cards and size % 2880 == 0
    assert len(tb.empty_primary()) == 2880


def test_formats():
    f = tb.parse_tform("1PJ(5)")
    assert (f.repeat, f.letter, f.descriptor, f.width, f.nbytes) == (1, "J", "P", 5, 8)
    assert tb.parse_tform("12X").nbytes == 2 and tb.parse_tform("8A").nbytes == 8
    assert tb.ascii_starts(["A15", "I11", "F15.6", "E13.5", "D22.14"]) == (80, [1, 17, 29, 45, 59])
    assert tb.binary_offsets(["8A", "1J", "1E"]) == (16, [0, 8, 12])
    assert tb.decode_tdim("(2,3)") == [2, 3] and tb.format_tdim([2, 3]) == "(2,3)"
    for bad, status in (("Q5", 262), ("F5.6", 261)):
        with pytest.raises(FitsError) as e:
            tb.parse_ascii_tform(bad)
        assert e.value.status == status
    assert tb.ascii_number(b" 1.25D2 ") == 125 and tb.ascii_number(b"   ") == 0 and tb.ascii_number(b"12345", 2) == 123.45 and tb.ascii_number(b"x") is None
    assert tb.format_ascii(1.25, ("E", 13, 5)) == b"  1.25000E+00"
    with pytest.raises(FitsError):
        tb.format_ascii(123456, ("I", 3, 0))


def test_checksums_and_status():
    assert checksum.encode(1234567890) == "dCW2fBU0dBU0dBU0"
    for v in (0, 1, 1 << 31, (1 << 32) - 2, 987654321):
        assert checksum.decode(checksum.encode(v)) == v and checksum.decode(checksum.encode(v, True), True) == v
    h = checksum.seal(Header(Header.parse(tb.empty_primary())[0].cards), checksum.add(0, b"abcd" * 720))
    assert checksum.verify(h, h.to_bytes(), b"abcd" * 720) == (1, 1)
    assert checksum.verify(h, h.to_bytes(), b"abce" * 720)[0] == -1
    assert text(412) == "datatype conversion overflow" and text(600) == "unknown error status"


def test_cards_as_columns_are_those_of_the_header(spark):
    """The column functions against the plain ones, and the statuses that both give."""
    from pyspark.sql import functions as F

    from skyframe.format import cards
    from skyframe.functions import columns

    names = ["A", "date-obs", "EXACTLY8", "NINECHARS", "A LONG NAME", "HIERARCH mixed Case", "n" * 25, "n" * 26]
    strings = ["", "x", "it's", "'" * 40, "y" * 67 + "'", "z" * 75, "w" * 42]
    rows = [(n, s, c) for n in names for s in strings for c in ("", "said", "l" * 80)]

    def plain(n, value, c):
        try:
            return f"{cards.make(n, value, c):<80}"
        except FitsError:
            return None

    for value, column in ((cards.quote, columns.quote(F.col("s"))), (lambda s: str(len(s)), F.length("s").cast("string")), (lambda s: "", F.lit(""))):
        good = [(*r, w) for r in rows if (w := plain(r[0], value(r[1]), r[2])) is not None]
        for r in spark.createDataFrame(good, "n string, s string, c string, want string").withColumn("got", columns.card(F.col("n"), column, F.col("c"))).collect():
            assert r["got"] == r["want"], r
    for bad in ("A=B", "n" * 75):
        with pytest.raises(Exception, match="207"):
            spark.range(1).select(columns.card(F.lit(bad), F.lit("123456"))).collect()
    with pytest.raises(Exception, match="308"):
        spark.range(1).select(columns.tdim_elem([2, 3], [F.lit(9), F.lit(9)])).collect()
    with pytest.raises(FitsError, match="111"):
        tb.decode_tdim("(4000000000,4000000000)")


def test_globs():
    from skyframe.format.header import fits_glob

    assert fits_glob("[AB]", "[AB]") and not fits_glob("A", "[AB]") and fits_glob("DATE-OBS", "D?TE*") and not fits_glob("DATE", "D?T")


def test_subint_and_sky_headers():
    from skyframe.format.header import Header
    from skyframe.operators import sky, subint

    assert subint.SubintInfo.of(Header()) == subint.SubintInfo(1, 0, 1, 8, 1, 0.0, False)
    h = Header().write("NPOL", 0).write("NBIN", 4).write("NCHAN", 2).write("ZERO_OFFS", 1.5).write("SIGNINT", True)
    info = subint.SubintInfo.of(h)
    assert (info.npol, info.samples, info.planes, info.zero_off, info.signint) == (1, 8, 2, 1.5, True)
    with pytest.raises(FitsError, match="505"):
        sky.img_coord(Header().write("CRVAL2", 1.0))
    got = sky.img_coord(Header().write("CRVAL1", 1).write("CROTA1", 5.0).write("CTYPE1", "RA---CAR"))
    assert got == {"ref": (1.0, 0.0), "pix": (0.0, 0.0), "inc": (1.0, 1.0), "rot": 5.0, "projection": "-CAR"}


def test_edits_in_place(spark, tmp_path):
    from skyframe.sources import fits

    path = str(tmp_path / "i.fits")
    d = spark.range(1, 13).selectExpr("id as _pix", "cast(id * 1000 as int) as value")
    fits.write_image(d.where("_pix <= 6"), path, [4, 3], "u16")
    assert [r[1] for r in fits.read_fits(spark, path, hdu=1).orderBy("_pix").collect()] == [i * 1000 if i <= 6 else 0 for i in range(1, 13)]
    fits.write_image(d, path, [12], "i32", append=True)
    assert [r["type"] for r in fits.fits_hdus(spark, path).orderBy("hdu").collect()] == ["image", "image"]
    assert fits.image_size(path, 2) == ("i32", [12]) and fits.image_size(path) == ("u16", [4, 3])
    fits.resize_image(spark, path, [2, 2, 2], "i8")
    assert fits.image_size(path, 2) == ("i8", [2, 2, 2]) and {r[1] for r in fits.read_fits(spark, path, hdu=2).collect()} == {0}
    for bad, code in ((70000, "412"), (None, "314")):
        with pytest.raises(Exception, match=code):
            fits.write_pixels(spark.createDataFrame([(1, bad)], "_pix long, value int"), path)
    with pytest.raises(Exception, match="308"):
        fits.write_pixels(spark.createDataFrame([(13, 1)], "_pix long, value int"), path)
    with pytest.raises(FitsError, match="105"):
        fits.write_image(d, path, [12], "i32")
    with pytest.raises(FitsError, match="235"):
        fits.write_rows(spark.createDataFrame([(1, bytearray(4))], "row long, bytes binary"), path, hdu=1)


def test_fixed_bytes():
    """Tiles worked out by hand from the published formats, so that a fault shared by encoder and decoder shows."""
    import gzip

    # RICE: the first pixel in 16 bits, then per block of 32 four bits that hold fs + 1 (0: all differences are 0); fs 0 is told by unary codes alone
    same = np.full(5, 7, np.int64)
    assert codec.rice_encode(same, 2) == bytes([0, 7, 0])
    steps = np.array([0, 1, 0, 0], np.int64)  # differences 0 1 -1 0, mapped 0 2 1 0
    bits = "0" * 16 + "0001" + "1" + "001" + "01" + "1"
    assert codec.rice_encode(steps, 2) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))
    # GZIP_1: the big-endian numbers; GZIP_2: their first bytes, then their second ones
    x = np.array([1, 258, -2], np.int64)
    assert gzip.decompress(codec.encode_tile(x, "GZIP_1", 2)) == b"\x00\x01\x01\x02\xff\xfe"
    assert gzip.decompress(codec.encode_tile(x, "GZIP_2", 2)) == b"\x00\x01\xff\x01\x02\xfe"
    assert codec.encode_tile(x, "NOCOMPRESS", 2) == b"\x00\x01\x01\x02\xff\xfe"
