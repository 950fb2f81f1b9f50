"""SUBINT tables: cubes of samples, packed or not, as calibrated numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..format import status
from ..format import tables as tb
from ..format.header import Header
from ..format.status import FitsError
from ..functions import columns as C
from ..sources import files
from ..sources.fits import read_fits


@dataclass
class SubintInfo:
    """How DATA cells are laid out: (bins, channels, polarisations) if there are bins, else (channels, polarisations, samples)."""

    npol: int = 1
    nbin: int = 0
    nchan: int = 1
    nbits: int = 8
    nsblk: int = 1
    zero_off: float = 0.0
    signint: bool = False

    @staticmethod
    def of(h: Header) -> SubintInfo:
        """From a header; what is missing or no number has its default."""

        def number(default: float, *names: str) -> float:
            return next((v for v in map(h.get, names) if isinstance(v, (int, float)) and not isinstance(v, bool)), default)

        whole = lambda name, default: int(number(default, name))
        return SubintInfo(
            max(whole("NPOL", 1), 1), whole("NBIN", 0), max(whole("NCHAN", 1), 1), max(whole("NBITS", 8), 1), max(whole("NSBLK", 1), 1),
            float(number(0.0, "ZERO_OFF", "ZERO_OFFS")), bool(h.get("SIGNINT", False)),
        )

    @property
    def planes(self) -> int:
        return self.nchan * self.npol

    @property
    def samples(self) -> int:
        return self.planes * (self.nbin if self.nbin > 1 else self.nsblk)

    def index(self, i: Column) -> tuple[Column, Column]:
        """(plane, channel) of element i from 0."""
        return C.fold_index(i, self.nbin, self.nchan) if self.nbin > 1 else C.search_index(i, self.nchan, self.npol)


def _subint(path: str, hdu: int | None, extname: str | None) -> files.Hdu:
    with files.open_bytes(files.list_files(path)[0]) as f:
        found = files.find(files.scan(f), hdu, extname)
    if found.kind != "binary":
        raise FitsError(227)
    return found


def subint_info(path: str, hdu: int | None = None, extname: str | None = None) -> SubintInfo:
    """Of a file, or of the first of a folder of files alike; an HDU that is no binary table: status 227."""
    return SubintInfo.of(_subint(path, hdu, extname).header)


def unpacked(cell: Column, nbit: int, signed: bool, n: int) -> Column:
    """The first n samples of nbit bits of an array of bytes, the first in the upper bits; too few bytes: status 306."""
    if nbit not in (1, 2, 4, 8):
        raise FitsError(410)
    per = 8 // nbit

    def sample(i: Column) -> Column:
        byte = F.pmod(F.get(cell, F.floor(i / per).cast("int")).cast("int"), F.lit(256))
        u = (F.floor(byte / F.pow(F.lit(2.0), 8 - nbit - nbit * (i % per))).cast("int") % (1 << nbit)).cast("int")
        return C.signed(u, nbit) if signed else u

    few = F.raise_error(F.lit("306: " + status.text(306))).cast("array<int>")
    return F.when(F.size(cell) * per >= n, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample)).otherwise(few)


def read_subint_data(spark: SparkSession, path: str, hdu: int | None = None, extname: str | None = None, weights: bool = False) -> DataFrame:
    """(_row, values) of the DATA cells: unpacked where bytes hold several samples, (raw - ZERO_OFF) * DAT_SCL + DAT_OFFS by plane, these 1 and 0
    where the table lacks them. weights: times DAT_WTS of the channel. Cells of the wrong length: status 320. Everything stays within a row."""
    found = _subint(path, hdu, extname)
    info, lay = SubintInfo.of(found.header), tb.layout(found.header)
    named = {c.name.upper(): c for c in lay.columns}
    if "DATA" not in named:
        raise FitsError(219, "DATA")
    wanted = [named[x].name for x in ("DATA", "DAT_SCL", "DAT_OFFS", *(["DAT_WTS"] if weights else [])) if x in named]
    if weights and "DAT_WTS" not in named:
        raise FitsError(219, "DAT_WTS")
    d = read_fits(spark, path, hdu=found.number, columns=wanted, rowid=True)
    as_array = lambda x: F.col(named[x].name) if named[x].form.repeat != 1 or named[x].form.descriptor else F.array(named[x].name)
    bad = F.raise_error(F.lit("320: " + status.text(320)))
    cell, letter, n = as_array("DATA"), named["DATA"].kind, info.samples
    if letter in "BS" and info.nbits < 8:
        raw = unpacked(cell, info.nbits, info.signint, n)
    else:
        raw = F.when(F.size(cell) >= n, F.slice(cell, 1, n)).otherwise(bad.cast(d.select(cell).schema[0].dataType))
        if letter in "BS" and info.nbits == 8:
            u = lambda x: F.pmod(x.cast("int"), F.lit(256))
            raw = F.transform(raw, lambda x: C.signed(u(x), 8) if info.signint else u(x))

    def plane_values(name: str, size: int, fill: float) -> Column:
        if name not in named:
            return F.array_repeat(F.lit(fill), size)
        return F.when(F.size(as_array(name)) == size, F.transform(as_array(name), lambda x: x.cast("double"))).otherwise(bad.cast("array<double>"))

    # each array is a column of its own, so that it is made once a row
    d = d.select("_row", raw.alias("raw"), plane_values("DAT_SCL", info.planes, 1.0).alias("scl"), plane_values("DAT_OFFS", info.planes, 0.0).alias("offs"), *([plane_values("DAT_WTS", info.nchan, 1.0).alias("wts")] if weights else []))

    def value(x: Column, i: Column) -> Column:
        plane, chan = (k.cast("int") for k in info.index(i))
        v = C.calibrate(x.cast("double"), F.get("scl", plane), F.get("offs", plane), info.zero_off)
        return v * F.get("wts", chan) if weights else v

    return d.select("_row", F.transform("raw", value).alias("values"))
