"""Encodings: written-out vectors, round trips, errors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stripelore import rle
from stripelore.errors import MalformedRleBlock

LONGS = st.integers(-(2**63), 2**63 - 1)


@given(st.lists(LONGS, max_size=50))
def test_zigzag(values):
    v = np.array(values, np.int64)
    assert rle.unzigzag(rle.zigzag(v)).tolist() == values


def test_zigzag_order():
    assert rle.zigzag(np.array([0, -1, 1, -2, 2])).tolist() == [0, 1, 2, 3, 4]


@given(st.integers(0, 2**200))
def test_varint(value):
    b = rle.encode_varint(value)
    assert rle.decode_varint(b + b"x") == (value, len(b))


def test_varint_cut():
    with pytest.raises(MalformedRleBlock):
        rle.decode_varint(b"\x80\x80")


def test_byte_runs():
    assert rle.decode_bytes(bytes([0x61, 0x00])).tolist() == [0] * 100
    assert rle.decode_bytes(bytes([0xFE, 0x44, 0x45])).tolist() == [0x44, 0x45]


@given(st.lists(st.integers(0, 3), max_size=700))
def test_bytes_round_trip(values):
    assert rle.decode_bytes(rle.encode_bytes(values), len(values)).tolist() == values


@given(st.lists(st.booleans(), max_size=300))
def test_booleans_round_trip(values):
    assert rle.decode_booleans(rle.encode_booleans(values), len(values)).tolist() == values


def test_booleans_high_bit_first():
    assert rle.decode_booleans(b"\xff\x80", 8).tolist() == [True] + [False] * 7


def test_v1_vectors():
    assert rle.decode_v1(bytes([0x61, 0x00, 0x07]), False).tolist() == [7] * 100
    assert rle.decode_v1(bytes([0x61, 0xFF, 0x64]), False).tolist() == list(range(100, 0, -1))
    assert rle.decode_v1(bytes([0xFB, 2, 3, 6, 7, 11]), False).tolist() == [2, 3, 6, 7, 11]
    assert rle.decode_v1(bytes([0x01, 0x02, 0x03]), True).tolist() == [-2, 0, 2, 4]


@settings(max_examples=60)
@given(st.one_of(st.lists(LONGS, max_size=300), st.lists(st.integers(-3, 3), max_size=400)), st.integers(1, 7))
def test_v1_round_trip(values, step):
    raw = rle.encode_v1(values, True)
    assert rle.decode_v1(raw, True, len(values)).tolist() == values
    assert rle.decode_v1(raw, True, len(values) // step).tolist() == values[: len(values) // step]


def test_v2_vectors():
    assert rle.decode_v2(bytes([0x0A, 0x27, 0x10]), False).tolist() == [10000] * 5
    assert rle.decode_v2(bytes([0x5E, 0x03, 0x5C, 0xA1, 0xAB, 0x1E, 0xDE, 0xAD, 0xBE, 0xEF]), False).tolist() == [23713, 43806, 57005, 48879]
    assert rle.decode_v2(bytes([0xC6, 0x09, 0x02, 0x02, 0x22, 0x42, 0x42, 0x46]), False).tolist() == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    patched = bytes([0x8E, 0x13, 0x2B, 0x21, 0x07, 0xD0, 0x1E, 0x00, 0x14, 0x70, 0x28, 0x32, 0x3C, 0x46, 0x50, 0x5A, 0x64, 0x6E, 0x78, 0x82, 0x8C, 0x96, 0xA0, 0xAA, 0xB4, 0xBE, 0xFC, 0xE8])
    want = [2030, 2000, 2020, 1000000, *range(2040, 2200, 10)]
    assert rle.decode_v2(patched, False).tolist() == want


def test_v2_delta_of_one_and_two():
    assert rle.decode_v2(bytes([0xC0, 0x00, 0x0A, 0x00]), True).tolist() == [5]
    assert rle.decode_v2(bytes([0xC0, 0x01, 0x0A, 0x03]), True).tolist() == [5, 3]


@pytest.mark.parametrize("raw", [b"\x5e\x03\x5c", b"\x0a\x27", b"\xc6\x09\x02", b"\x8e\x13\x2b\x21\x07"])
def test_v2_cut(raw):
    with pytest.raises(MalformedRleBlock):
        rle.decode_v2(raw, False)


def test_too_few():
    with pytest.raises(MalformedRleBlock):
        rle.decode_v1(bytes([0x00, 0x00, 0x01]), False, 4)


@given(st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_unpack(width, values):
    values = [v & (1 << width) - 1 for v in values]
    bits = "".join(f"{v:0{width}b}" for v in values)
    bits += "0" * (-len(bits) % 8)
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    assert rle.unpack(raw, width, len(values)).tolist() == values


def test_coded_big_endian():
    assert rle.coded_big_endian(b"\x27\x10", False) == 10000
    assert rle.coded_big_endian(b"\x03", True) == -2
    with pytest.raises(MalformedRleBlock):
        rle.coded_big_endian(b"", True)
