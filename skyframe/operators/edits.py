"""Edits of tables and containers as transforms of DataFrames and of lists of HDUs."""

from __future__ import annotations

import gzip
import os
import sys
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..format import tables as tb
from ..format.header import Header, fits_glob
from ..format.status import FitsError
from ..sources import files, fits


def insert_rows(df: DataFrame, after: int, n: int, row: str = "_row") -> DataFrame:
    """n rows of nulls after row `after` (0: on top); rows are numbered from 1 in `row`. Nothing is shuffled."""
    if n < 0:
        raise FitsError(306)
    moved = df.withColumn(row, F.when(F.col(row) > after, F.col(row) + n).otherwise(F.col(row)).cast("long"))
    empty = df.sparkSession.range(after + 1, after + n + 1).select(*[F.col("id").alias(c) if c == row else F.lit(None).cast(t).alias(c) for c, t in moved.dtypes])
    return moved.unionByName(empty)


def delete_rows(df: DataFrame, first: int, n: int, row: str = "_row") -> DataFrame:
    kept = df.where(~F.col(row).between(first, first + n - 1))
    return kept.withColumn(row, F.when(F.col(row) >= first + n, F.col(row) - n).otherwise(F.col(row)).cast("long"))


def insert_column(df: DataFrame, at: int, name: str, kind: str) -> DataFrame:
    """A column of nulls at place `at` from 1."""
    cols = df.columns
    return df.select(*cols[: at - 1], F.lit(None).cast(kind).alias(name), *cols[at - 1 :])


def map_files(df: DataFrame, edit, content: str = "content") -> DataFrame:
    """df with each file of a binary column edited: edit(Container) changes it in place or returns another. A file is a unit of work; null stays null."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        def one(data):
            box = Container(bytes(data))
            return (edit(box) or box).to_bytes()

        return s.map(one, na_action="ignore")

    return df.withColumn(content, f(F.col(content)))


def find_columns(df: DataFrame, pattern: str, case: bool = False) -> list[str]:
    """Names that fit a pattern with * and ?; none: status 219."""
    fold = (lambda s: s) if case else str.lower
    found = [c for c in df.columns if fits_glob(fold(c), fold(pattern))]
    if not found:
        raise FitsError(219, pattern)
    return found


def find_column(df: DataFrame, pattern: str, case: bool = False) -> str:
    found = find_columns(df, pattern, case)
    if len(found) > 1:
        raise FitsError(237, *found)
    return found[0]


class Container:
    """The HDUs of one file as (header, data) in order, for surgery; numbers count from 1. Meant for files of a size that one machine holds."""

    def __init__(self, data: bytes | None = None) -> None:
        data = files.in_memory(data or tb.empty_primary()).getvalue()
        self.units = [(h.header, data[h.data_start : h.data_start + h.data_bytes]) for h in files.scan_bytes(data)]

    @staticmethod
    def open(path: str) -> Container:
        return Container(files.read_all(path))

    def save(self, path: str) -> Container:
        """To a new file, one that is there with ! before its name, or standard output for -; gzipped where the name ends so."""
        data = self.to_bytes()
        if path.strip() in ("-", "stdout"):
            sys.stdout.buffer.write(data)
            sys.stdout.buffer.flush()
            return self
        name = files.local(path.removeprefix("!"))
        if name is None or os.path.exists(name) and not path.startswith("!"):
            raise FitsError(105, path)
        stage = f"{name}.tmp-{uuid.uuid4().hex}"
        with open(stage, "wb") as f:
            f.write(gzip.compress(data, 6) if name.endswith(".gz") else data)
        os.replace(stage, name)
        return self

    def to_bytes(self) -> bytes:
        fill = lambda h: b" " if (h.get("XTENSION") or "").strip() == "TABLE" else b"\0"
        return b"".join(h.to_bytes() + tb.padded(d, fill(h)) for h, d in self.units)

    def hdu_bytes(self, n: int) -> bytes:
        one = Container()
        one.units = [self.units[n - 1]]
        return one.to_bytes()

    def delete(self, n: int) -> Container:
        """Deleting the primary leaves an empty one."""
        if not 1 <= n <= len(self.units):
            raise FitsError(301, str(n))
        if n == 1:
            self.units[0] = Container().units[0]
        else:
            del self.units[n - 1]
        return self

    def insert(self, n: int, header: Header, data: bytes = b"") -> Container:
        """After HDU n."""
        self.units.insert(n, (as_extension(header), data))
        return self

    def insert_image(self, n: int, kind: str, axes: list[int]) -> Container:
        """An image of 0 after HDU n."""
        header = fits.image_header(axes, kind, extension=True)
        bitpix, zero = fits.IMAGE_TYPES[kind]
        dtype = np.dtype(fits.PIXELS[bitpix, zero][0])
        return self.insert(n, header, np.full(int(np.prod(axes)) if axes else 0, -zero, np.int64).astype(dtype).tobytes())

    def insert_table(self, n: int, names: list[str], formats: list[str], rows: int, units: list[str] | None = None, extname: str = "", ascii_: bool = False) -> Container:
        """A table of empty cells after HDU n: 0, or blanks in an ASCII table."""
        if rows < 0:
            raise FitsError(218)
        columns, at = [], 0
        for name, text, unit in zip(names, formats, units or [""] * len(names), strict=True):
            form, zero = (tb.parse_ascii_tform(text), 0) if ascii_ else (tb.parse_tform(text), 0)
            if not ascii_:
                form.letter, zero = tb.STORED.get(form.letter, (form.letter, 0))
            columns.append(tb.Column(name, form, zero=zero, offset=at, unit=unit or ""))
            at += form[1] + 1 if ascii_ else form.nbytes
        header = tb.ascii_header(columns, rows, extname) if ascii_ else tb.table_header(columns, rows, 0, extname)
        return self.insert(n, header, (b" " if ascii_ else b"\0") * (header.get("NAXIS1") * rows))

    def copy(self, n: int, other: Container) -> Container:
        """HDU n to the end of other; images become extensions, or the primary of an empty container."""
        header, data = self.units[n - 1]
        if len(other.units) == 1 and other.units[0][0].get("NAXIS") == 0 and not other.units[0][1] and not (header.get("XTENSION") or "IMAGE").strip() != "IMAGE":
            other.units[0] = (as_primary(header), data)
        else:
            other.units.append((as_extension(header), data))
        return other

    def copy_file(self, n: int, other: Container, previous: bool = False, current: bool = True, following: bool = False) -> Container:
        for k in range(1, len(self.units) + 1):
            if k < n and previous or k == n and current or k > n and following:
                self.copy(k, other)
        return other


def as_extension(h: Header) -> Header:
    if h.cards[0].startswith("XTENSION"):
        return Header(h.cards)
    out = Header([c for c in h.cards[1:] if c[:8].strip() not in ("EXTEND", "PCOUNT", "GCOUNT") and not c.startswith(("COMMENT   FITS (Flex", "COMMENT   and Astro"))])
    out.put(Header.card("XTENSION", "IMAGE", "IMAGE extension"), 1)
    at = out.get("NAXIS") + 4
    out.put(Header.card("PCOUNT", 0, "required keyword; must = 0"), at)
    return out.put(Header.card("GCOUNT", 1, "required keyword; must = 1"), at + 1)


def as_primary(h: Header) -> Header:
    if not h.cards[0].startswith("XTENSION"):
        return Header(h.cards)
    out = Header([c for c in h.cards[1:] if c[:8].strip() not in ("PCOUNT", "GCOUNT")])
    out.put(Header.card("SIMPLE", True, "file does conform to FITS standard"), 1)
    return out.put(Header.card("EXTEND", True, "FITS dataset may contain extensions"), out.get("NAXIS") + 4)
