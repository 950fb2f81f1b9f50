"""The format's computations as column expressions: cards, scaling, indices, samples, cubes, sky coordinates, dates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..format import cards as C
from ..format import status

#: Degrees to radians as the format's tools cut it.
D2R = 0.01745329252


# --- cards -----------------------------------------------------------------------------------------------------------


def quote(s: Column) -> Column:
    """A string value: quotes doubled, 68 characters at most, a doubled quote never cut in two, at least eight between the quotes."""
    doubled = F.replace(s, F.lit("'"), F.lit("''"))
    cut = F.regexp_extract(doubled, r"(?s)^((?:[^']|''){0,68})", 1)
    # 68 pairs may be longer: of these as many as fit
    cut = F.when(F.length(doubled) <= 68, doubled).when(F.length(cut) <= 68, cut).otherwise(F.regexp_extract(F.substring(doubled, 1, 68), r"(?s)^((?:[^']|'')*)", 1))
    return F.concat(F.lit("'"), F.rpad(cut, F.greatest(F.length(cut), F.lit(8)), F.lit(" ")), F.lit("'"))


def unquote(v: Column) -> Column:
    inner = F.regexp_extract(v, r"^'((?:[^']|'')*)'?", 1)
    return F.when(F.startswith(v, F.lit("'")), F.rtrim(F.replace(inner, F.lit("''"), F.lit("'")))).otherwise(F.trim(v))


def card(name: Column, value: Column, comment: Column | None = None) -> Column:
    """A card of 80 characters; value as written, quoted if a string. Names of up to eight letters, digits, _ and - take the first eight places,
    others make a HIERARCH card, whose blank before = goes where there is no room for it. Without a value the comment alone follows the name.
    A name with = or without room for its value: status 207."""
    bad = F.raise_error(F.lit("207: " + status.text(207))).cast("string")
    name, said = F.trim(name), F.coalesce(comment, F.lit("")) if comment is not None else F.lit("")
    short = name.rlike(r"\A[A-Za-z0-9_-]{0,8}\z")
    named = F.when(F.upper(name).startswith("HIERARCH "), name).otherwise(F.concat(F.lit("HIERARCH "), name))
    tight = F.length(named) + 3 + F.length(value) > 80
    long_ = F.concat(named, F.when(tight, F.lit("= ")).otherwise(F.lit(" = ")))
    long_ = F.when(name.contains("=") | ~name.rlike(r"\A[ -~]+\z") | (F.length(named) + 2 + F.length(value) > 80), bad).otherwise(long_)
    head = F.when(short, F.concat(F.rpad(F.upper(name), F.lit(8), F.lit(" ")), F.lit("= "))).otherwise(long_)
    full = F.concat(head, value)
    text = F.when(F.length(full) > 80, F.concat(F.substring(full, 1, 79), F.lit("'"))).otherwise(full)
    text = F.when(F.length(head) > 10, text).otherwise(F.rpad(text, F.greatest(F.length(text), F.lit(30)), F.lit(" ")))
    number = F.when(F.length(head) > 10, full).otherwise(F.concat(head, F.lpad(value, F.greatest(F.length(value), F.lit(20)), F.lit(" "))))
    body = F.when(F.startswith(value, F.lit("'")), text).otherwise(number)
    body = F.when((F.length(said) > 0) & (F.length(body) + 3 < 80), F.concat(body, F.lit(" / "), said)).otherwise(body)
    body = F.when(short & (F.length(value) == 0), F.concat(F.rpad(F.upper(name), F.lit(8), F.lit(" ")), F.lit("  "), said)).otherwise(body)
    return F.rpad(body, F.lit(80), F.lit(" "))


def card_keyword(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit("HIERARCH ")) & F.contains(c, F.lit("=")), F.trim(F.regexp_extract(c, r"^HIERARCH ([^=]*)=", 1))).otherwise(F.trim(F.substring(c, 1, 8)))


def card_value(c: Column) -> Column:
    rest = F.when(F.startswith(c, F.lit("HIERARCH ")), F.regexp_extract(c, r"^[^=]*=(.*)$", 1)).when(F.substring(c, 9, 2) == "= ", F.substring(c, 11, 70)).when(F.startswith(c, F.lit("CONTINUE")), F.substring(c, 9, 72)).otherwise("")
    t = F.ltrim(rest)
    return F.when(F.startswith(t, F.lit("'")), F.regexp_extract(t, r"^('(?:[^']|'')*')", 1)).when(F.startswith(t, F.lit("(")), F.regexp_extract(t, r"^(\([^)]*\))", 1)).otherwise(F.trim(F.regexp_extract(t, r"^([^/]*)", 1)))


def card_comment(c: Column) -> Column:
    rest = F.when(F.startswith(c, F.lit("HIERARCH ")), F.regexp_extract(c, r"^[^=]*=(.*)$", 1)).otherwise(F.substring(c, 11, 70))
    after = F.trim(F.regexp_extract(F.ltrim(rest), r"^(?:'(?:[^']|'')*'|\([^)]*\)|[^/]*)\s*/(.*)$", 1))
    plain = (F.substring(c, 9, 2) != "= ") & ~F.startswith(c, F.lit("HIERARCH ")) & ~F.startswith(c, F.lit("CONTINUE"))
    return F.when(plain, F.rtrim(F.substring(c, 9, 72))).otherwise(after)


def key_class(c: Column) -> Column:
    key = F.rpad(F.upper(F.substring(c, 1, 8)), F.lit(8), F.lit(" "))
    out = F.lit(C.USER)
    for code, pattern in reversed(C.CLASSES):
        out = F.when(key.rlike(pattern), F.lit(code)).otherwise(out)
    standard = F.lit(False)
    for s in C.STANDARD_COMMENTS:
        standard = standard | F.startswith(F.substring(c, 11, 70), F.lit(s))
    return F.when((key == "COMMENT ") & standard, 10).when(F.startswith(c, F.lit("EXTNAME = 'COMPRESSED_IMAGE'")), 20).otherwise(out)


def valid_keyword(name: Column) -> Column:
    return F.substring(name, 1, 8).rlike(r"^[A-Z0-9_-]* *$")


def comment_chunks(df: DataFrame, text: str, keyword: str = "COMMENT") -> DataFrame:
    """A row for each card of 72 characters of a text: n from 1, card."""
    n = F.greatest(F.ceil(F.length(text) / 72), F.lit(1)).cast("int")
    return df.withColumn("n", F.explode(F.sequence(F.lit(1), n))).withColumn("card", F.concat(F.rpad(F.lit(keyword), F.lit(8), F.lit(" ")), F.substr(F.col(text), (F.col("n") - 1) * 72 + 1, F.lit(72))))


# --- numbers ---------------------------------------------------------------------------------------------------------


def nearest(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x)


def to_physical(stored: Column, scale: float = 1, zero: float = 0) -> Column:
    return stored * F.lit(scale) + F.lit(zero) if scale != 1 else stored + F.lit(zero)


def to_stored(physical: Column, scale: float = 1, zero: float = 0, bits: int = 16) -> Column:
    if scale == 0:
        raise status.FitsError(322)
    v = nearest((physical - F.lit(float(zero))) / F.lit(float(scale)))
    low, high = -float(1 << (bits - 1)), float((1 << (bits - 1)) - 1)
    return F.when(v.between(low, high), v.cast("bigint")).otherwise(F.raise_error(F.lit("412: " + status.text(412))).cast("bigint"))


def with_null(stored: Column, null: int) -> Column:
    return F.nullif(stored, F.lit(null))


def number_text(x: Column, decimals: int, exponent: bool) -> Column:
    """As C writes it: ties go to the even digit, which Java's formatter does not."""
    code = "E" if exponent else "f"

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v != v else f"{v:.{decimals}{code}}")

    return f(x)


# --- arrays ----------------------------------------------------------------------------------------------------------


def tdim_elem(dims: list[int], coords: list[Column]) -> Column:
    """The 1-based element of 1-based coordinates, the first axis fastest; a coordinate past its axis: status 308."""
    out, step, inside = F.lit(1).cast("bigint"), 1, F.lit(True)
    for n, c in zip(dims, coords, strict=True):
        out, step, inside = out + (c - 1) * step, step * n, inside & c.between(1, n)
    return F.when(inside, out).when(inside.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("308: " + status.text(308))).cast("bigint"))


def tdim_coords(dims: list[int], elem: Column) -> list[Column]:
    out, step = [], 1
    for n in dims:
        out.append((F.floor((elem - 1) / step) % n + 1).cast("bigint"))
        step *= n
    return out


def null_to(value: Column, nulval) -> Column:
    """A column with its nulls as nulval."""
    return F.coalesce(value, F.lit(nulval))


def any_null(value: Column) -> Column:
    """Whether a column has a null, an aggregate."""
    return F.coalesce(F.max(value.isNull()), F.lit(False))


def explode_cells(df: DataFrame, cell: str, row: str = "_row", repeat: int | None = None) -> DataFrame:
    """Elements of vector cells: elem from 1 in the cell and, with a fixed repeat, flat from 1 in the column."""
    out = df.select("*", F.posexplode(cell).alias("_p", "elem_value")).withColumn("elem", F.col("_p") + 1)
    if repeat:
        out = out.withColumn("flat", (F.col(row) - 1) * repeat + F.col("elem"))
    return out.drop("_p", cell)


# --- samples and cubes -----------------------------------------------------------------------------------------------


def pack(df: DataFrame, index: str, sample: str, nbit: int, *keys: str) -> DataFrame:
    """Bytes of unsigned n-bit samples (index from 0), the first in the upper bits: byte_index, byte."""
    if nbit not in (1, 2, 4, 8):
        raise status.FitsError(410)
    per = 8 // nbit
    bits = F.col(sample).cast("bigint") * F.pow(F.lit(2.0), 8 - nbit - nbit * (F.col(index) % per)).cast("bigint")
    good = F.when(F.col(sample).between(0, (1 << nbit) - 1), bits).otherwise(F.raise_error(F.lit("410: " + status.text(410))).cast("bigint"))
    return df.groupBy(*keys, F.floor(F.col(index) / per).alias("byte_index")).agg(F.sum(good).alias("byte"))


def unpack(df: DataFrame, byte_index: str, byte: str, nbit: int, nsamp: int = 0) -> DataFrame:
    """The samples of each byte: sample_index from 0, sample. nsamp: only the first so many, 0 for all; fewer than 0: status 306.
    That there are as many bytes is not known without counting them, so a shorter table gives what it has."""
    if nsamp < 0:
        raise status.FitsError(306)
    per = 8 // nbit
    out = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    value = F.floor(F.col(byte) / F.pow(F.lit(2.0), 8 - nbit - nbit * F.col("_k"))) % (1 << nbit)
    out = out.withColumns({"sample_index": F.col(byte_index) * per + F.col("_k"), "sample": value.cast("bigint")}).drop("_k")
    return out.where(F.col("sample_index") < nsamp) if nsamp else out


def signed(u: Column, nbit: int) -> Column:
    return F.when(u >= 1 << (nbit - 1), u - (1 << nbit)).otherwise(u)


def clamp_sample(x: Column, nbit: int, signed_: bool) -> Column:
    low, high = (-(1 << (nbit - 1)), (1 << (nbit - 1)) - 1) if signed_ else (0, (1 << nbit) - 1)
    v = F.greatest(F.least(nearest(x), F.lit(float(high))), F.lit(float(low))).cast("bigint")
    return F.when(v < 0, v + (1 << nbit)).otherwise(v) if signed_ else v


def fold_index(i: Column, nbin: int, nchan: int) -> tuple[Column, Column]:
    """(plane, channel) of element i from 0 of a cube (bin, channel, polarisation); plane = channel + nchan * polarisation."""
    plane = F.floor(i / nbin).cast("bigint")
    return plane, plane % nchan


def search_index(i: Column, nchan: int, npol: int) -> tuple[Column, Column]:
    """The same of a cube (channel, polarisation, sample)."""
    return i % (nchan * npol), i % nchan


def calibrate(raw: Column, scale: Column, offset: Column, zero_off: float = 0) -> Column:
    return (raw - F.lit(zero_off)) * scale + offset


def uncalibrate(x: Column, scale: Column, offset: Column, zero_off: float = 0) -> Column:
    return F.when(scale == 0, F.raise_error(F.lit("322: " + status.text(322))).cast("double")).otherwise((x - offset) / scale + F.lit(zero_off))


def channel_weighted(x: Column, weight: Column) -> Column:
    """A sample times the weight of its channel."""
    return x * weight


# --- sky -------------------------------------------------------------------------------------------------------------


def pix_to_world(x: Column, y: Column, ref: tuple[float, float], pix: tuple[float, float], inc: tuple[float, float], rot: float = 0.0, projection: str = "-TAN") -> tuple[Column, Column]:
    """(longitude, latitude) in degrees for -CAR and -TAN; others: status 504."""
    dx, dy = (x - pix[0]) * inc[0], (y - pix[1]) * inc[1]
    if rot:
        c, s = F.cos(F.lit(rot * D2R)), F.sin(F.lit(rot * D2R))
        dx, dy = dx * c - dy * s, dy * c + dx * s
    ra0, dec0 = F.lit(ref[0] * D2R), F.lit(ref[1] * D2R)
    ell, m = dx * D2R, dy * D2R
    if projection[-3:] == "CAR":
        ra, dec = ra0 + ell, dec0 + m
    elif projection[-3:] == "TAN":
        a = F.cos(dec0) * F.cos(ra0) - ell * F.sin(ra0) - m * F.cos(ra0) * F.sin(dec0)
        b = F.cos(dec0) * F.sin(ra0) + ell * F.cos(ra0) - m * F.sin(ra0) * F.sin(dec0)
        z = F.sin(dec0) + m * F.cos(dec0)
        ra, dec = F.atan2(b, a), F.atan(z / F.sqrt(a * a + b * b))
    else:
        raise status.FitsError(504, projection)
    lon = ra / D2R
    return F.when(lon < 0, lon + 360).when(lon >= 360, lon - 360).otherwise(lon), dec / D2R


def world_to_pix(lon: Column, lat: Column, ref: tuple[float, float], pix: tuple[float, float], inc: tuple[float, float], rot: float = 0.0, projection: str = "-TAN") -> tuple[Column, Column]:
    """The inverse; a point behind the tangent plane raises 501."""
    ra0, dec0 = ref[0] * D2R, ref[1] * D2R
    if projection[-3:] == "CAR":
        dx, dy = (lon - ref[0]), (lat - ref[1])
    elif projection[-3:] == "TAN":
        ra, dec = lon * D2R, lat * D2R
        cos0, sin0 = math.cos(dec0), math.sin(dec0)
        cosd, sind = F.cos(dec), F.sin(dec)
        front = sind * sin0 + cosd * cos0 * F.cos(ra - ra0)
        front = F.when(front > 0, front).otherwise(F.raise_error(F.lit("501: " + status.text(501))).cast("double"))
        if cos0 < 0.001:
            t = cosd * F.cos(ra - ra0) / (sind * sin0)
            m = (-t + cos0 * (1.0 + t * t)) / sin0
        else:
            m = (sind / front - sin0) / cos0
        if abs(math.sin(ra0)) < 0.3:
            ell = (cosd * F.sin(ra) / front - cos0 * math.sin(ra0) + m * (math.sin(ra0) * sin0)) / math.cos(ra0)
        else:
            ell = (cosd * F.cos(ra) / front - cos0 * math.cos(ra0) + m * (math.cos(ra0) * sin0)) / -math.sin(ra0)
        dx, dy = ell / D2R, m / D2R
    else:
        raise status.FitsError(504, projection)
    if rot:
        c, s = math.cos(rot * D2R), math.sin(rot * D2R)
        dx, dy = dx * c + dy * s, dy * c - dx * s
    return dx / inc[0] + pix[0], dy / inc[1] + pix[1]


# --- dates and status ------------------------------------------------------------------------------------------------


def fits_datetime(seconds: Column) -> Column:
    """ISO text of Unix seconds, in UTC whatever the session's zone."""
    t = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")


def is_fits_date(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}")


def status_text(code: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in status.TEXTS.items() for x in pair])
    return F.coalesce(F.element_at(texts, code), F.lit(status.UNKNOWN))
