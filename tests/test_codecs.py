"""Tile codecs give back what they were given."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyframe.codecs import htransform as H
from skyframe.codecs import tiles as T
from skyframe.format.status import FitsError


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=200), st.integers(1, 5))
def test_lossless(values, times):
    p = np.repeat(np.array(values, np.int64), times)
    for width in (2, 4):
        assert (T.rice_decode(T.rice_encode(p, width), len(p), width) == p).all()
    assert (T.rice_decode(T.rice_encode(p & 255, 1), len(p), 1) == p & 255).all()
    for name in ("GZIP_1", "GZIP_2", "NOCOMPRESS"):
        assert (T.decode_tile(T.encode_tile(p, name), len(p), name) == p).all()
    q = np.where(p > 0, p * 400, 0)
    assert (T.decode_tile(T.encode_tile(q, "PLIO_1"), len(q), "PLIO_1") == q).all()


def test_quantized():
    assert abs(float(T.dither_table()[0]) - 7.826369e-6) < 1e-11
    x = np.random.default_rng(1).normal(5, 1, 3000)
    x[7] = np.nan
    for method in (0, 1, 2):
        q, step, zero = T.quantize(x, 16, method, 3)
        back = T.dequantize(q, step, zero, method, 3)
        assert np.nanmax(abs(back - x)) <= step * 0.5001 and np.isnan(back[7])
    assert T.quantize(np.full(50, 5.0)) is None


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 31), st.integers(0, 99))
def test_htransform(x, y, bits, seed):
    image = np.random.default_rng(seed).integers(-(1 << bits), 1 << bits, (x, y))
    data = H.encode(image)
    assert (H.decode(data) == image).all()
    assert (T.decode_tile(T.encode_tile(image.ravel(), "HCOMPRESS_1", width=y), x * y, "HCOMPRESS_1") == image.ravel()).all()


def test_htransform_scaled_and_broken():
    image = (1000 * np.sin(np.arange(64)[:, None] / 9) + np.random.default_rng(1).normal(0, 3, (64, 48))).astype(int)
    whole, scaled = H.encode(image), H.encode(image, 16)
    assert whole[:2] == b"\xdd\x99" and len(scaled) < len(whole) and abs(H.decode(scaled) - image).max() < 16
    for bad in (b"", b"xx" + whole[2:], whole[: len(whole) // 2]):
        with pytest.raises(FitsError):
            H.decode(bad)


def stream(*bits: str) -> bytes:
    """Bits as bytes, the last one filled up with 0."""
    text = "".join(bits).replace(" ", "")
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8)


@pytest.mark.parametrize(
    "width, pixels, bits",
    [
        (2, [10, 12, 11], f"{10:016b} 0001 1 00001 01"),  # folded differences 0, 4, 1, no split
        (4, [0, 8, 0, 8], f"{0:032b} 00100 1000 001000 01111 001000"),  # 0, 16, 15, 16, split after three bits
        (1, [5, 5, 5], f"{5:08b} 000"),  # no differences at all
        (1, [0, 100, 0, 100], f"{0:08b} 111 {0:08b} {200:08b} {199:08b} {200:08b}"),  # too large to be split
    ],
)
def test_rice_bits(width, pixels, bits):
    """Worked by hand."""
    assert T.rice_encode(pixels, width) == stream(bits)
    assert T.rice_decode(stream(bits), len(pixels), width).tolist() == pixels


@pytest.mark.parametrize(
    "pixels, words",
    [
        ([0, 0, 0, 1, 1, 0], [3, 0x4002, 1]),
        ([5, 0, 0, 9], [0x6004, 0x2004, 0x5003]),
        ([9, 2], [0x6008, 0x7007]),
        ([70000, 70000, 3], [0x1170, 0x0011, 0x4002, 0x1003, 0, 0x4001]),
    ],
)
def test_plio_words(pixels, words):
    """Worked by hand; seven words come before."""
    got = T.plio_encode(pixels).view(np.uint16).tolist()
    assert got == [0, 7, 65536 - 100, len(words) + 7, 0, 0, 0, *words]
    assert T.plio_decode(np.array(got, np.uint16).view(np.int16), len(pixels)).tolist() == pixels


def test_htransform_bits():
    """Worked by hand: sum 12 (of 10, rounded to fours), differences 2 along rows and 4 along columns, none across; three planes."""
    none, one = "1111 111110", "1111 011"
    data = b"\xdd\x99" + bytes([0, 0, 0, 2, 0, 0, 0, 2, 0, 0, 0, 0, *[0] * 7, 12, 0, 3, 0]) + stream(none, one, none, one, none, none, "0000") + b"\0"
    assert H.encode(np.array([[1, 2], [3, 4]])) == data
    assert H.decode(data).tolist() == [[1, 2], [3, 4]]


def test_broken_streams():
    rice, plio = T.rice_encode(np.arange(99) ** 2 % 97, 2), T.plio_encode(np.arange(99) % 5)
    for cut in (0, 1, 3, len(rice) // 2):
        with pytest.raises(FitsError):
            T.rice_decode(rice[:cut], 99, 2)
    with pytest.raises(FitsError):
        T.plio_decode(plio[:-3], 99)
    assert T.plio_decode(T.plio_encode([]), 4).tolist() == [0] * 4
