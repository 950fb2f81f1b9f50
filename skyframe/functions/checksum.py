"""Checksums of HDUs: ones'-complement sums of 32-bit words, as an aggregate and as text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..format.header import Header

M = (1 << 32) - 1
#: Codes that the text must not hold.
EXCLUDED = (*range(0x3A, 0x41), *range(0x5B, 0x61))


def add(total: int, data: bytes) -> int:
    """total and the words of data, added with end-around carry; data are padded with zeros to whole words."""
    data += b"\0" * (-len(data) % 4)
    return fold(total + int(np.frombuffer(data, ">u4").astype(np.uint64).sum(dtype=np.uint64)))


def fold(total: int) -> int:
    return 0 if total == 0 else (total - 1) % M + 1


def fold_column(total: Column) -> Column:
    """The checksum of a plain sum of words: an aggregate that tasks compute in part, in any order."""
    return F.when(total == 0, F.lit(0)).otherwise((total - 1) % M + 1).cast("long")


def encode(value: int, complement: bool = False) -> str:
    value = M - value if complement else value
    out = [0] * 16
    for i in range(4):
        byte = value >> (24 - 8 * i) & 255
        quarter = [byte // 4 + 48] * 4
        quarter[0] += byte % 4
        while any(c in EXCLUDED for c in quarter):
            for j in (0, 2):
                if quarter[j] in EXCLUDED or quarter[j + 1] in EXCLUDED:
                    quarter[j] += 1
                    quarter[j + 1] -= 1
        for j in range(4):
            out[4 * j + i] = quarter[j]
    return bytes(out[-1:] + out[:-1]).decode()


def decode(text: str, complement: bool = False) -> int:
    b = text.encode()
    b = b[1:] + b[:1]
    total = sum(sum(b[4 * j + i] - 48 for j in range(4)) << (24 - 8 * i) for i in range(4))
    total = fold(total)
    return M - total if complement else total


def decode_column(text: Column) -> Column:
    at = lambda k: F.ascii(F.substring(text, k % 16 + 1, 1)).cast("long") - 48
    total = sum(((at(1 + i) + at(5 + i) + at(9 + i) + at(13 + i)) * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    return fold_column(total)


def seal(h: Header, datasum: int) -> Header:
    """With DATASUM, and CHECKSUM such that the sum of the whole HDU is all ones."""
    h.update("DATASUM", str(datasum), "data unit checksum")
    h.update("CHECKSUM", "0" * 16, "HDU checksum")
    return h.update("CHECKSUM", encode(add(datasum, h.to_bytes()), True), "HDU checksum")


def verify(header: Header, header_bytes: bytes, data: bytes) -> tuple[int, int]:
    """(data, HDU): 1 right, 0 absent, -1 wrong."""
    datasum = add(0, data)
    total = add(datasum, header_bytes)
    d = 0 if not header.has("DATASUM") else 1 if int(header.get("DATASUM")) == datasum else -1
    return d, 0 if not header.has("CHECKSUM") else 1 if total in (0, M) else -1
