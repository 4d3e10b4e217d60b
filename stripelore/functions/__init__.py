"""Column functions over ORC's encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rle
from ..codecs import Compression
from ..wire import COMPRESSIONS


def zigzag_encode(c: Column) -> Column:
    """Signed long -> the long whose bits are its zigzag form, in the JVM."""
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def zigzag_decode(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1).cast("long"))))


def varint_encode(c: Column) -> Column:
    """Long from 0 on -> its variable-length bytes, in the JVM; a negative one counts as its unsigned 64-bit pattern. Arithmetic on one long, no
    arrays: the first eight groups of seven bits go to the bytes of a long, the highest first."""
    c = c.cast("long")
    long = lambda v: F.lit(v).cast("long")
    all_marked = sum(128 << 8 * i for i in range(8)) - (1 << 64)
    size, marks, word = F.when(c < 0, 10), F.when(c < 0, long(all_marked)), long(0)
    for n in range(1, 9):
        below = c < 1 << 7 * n
        mark = sum(128 << 8 * (7 - i) for i in range(n - 1))
        size, marks = size.when(below, n), marks.when(below, long(mark - (1 << 64) if mark >> 63 else mark))
        word = word.bitwiseOR(F.shiftleft(F.shiftrightunsigned(c, 7 * (n - 1)).bitwiseAND(long(127)), 8 * (8 - n)))
    octets = F.lpad(F.hex(word.bitwiseOR(marks.otherwise(long(all_marked)))), 16, "0")
    last = F.when(c < 0, F.concat(F.hex(F.shiftrightunsigned(c, 56).bitwiseOR(long(128))), F.lit("01"))).when(c >= 1 << 56, F.lpad(F.hex(F.shiftright(c, 56)), 2, "0")).otherwise("")
    return F.unhex(F.concat(F.substring(octets, F.lit(1), 2 * size.otherwise(9)), last))


def varint_decode(c: Column) -> Column:
    """The number that the bytes of one variable-length number stand for, as a long, in the JVM."""

    def number(first: int, length: int) -> Column:
        return F.conv(F.rpad(F.hex(F.substring(c, first, length)), 2 * length, "0"), 16, -10).cast("long")

    word, value, rest = number(1, 8), F.lit(0).cast("long"), number(9, 2)
    for i in range(8):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, 8 * (7 - i)).bitwiseAND(F.lit(127).cast("long")), 7 * i))
    high = F.shiftleft(F.shiftrightunsigned(rest, 8).bitwiseAND(F.lit(127).cast("long")), 56).bitwiseOR(F.shiftleft(rest, 63))
    return value.bitwiseOR(F.when(F.octet_length(c) > 8, high).otherwise(F.lit(0).cast("long")))


# types as objects: text would need a session when this module is imported
@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_integers(data: pd.Series, encoding: pd.Series, signed: pd.Series) -> pd.Series:
    """All numbers of a decompressed stream; encoding is DIRECT, DICTIONARY, DIRECT_V2 or DICTIONARY_V2. Null data give null."""
    return pd.Series([None if d is None else rle.decode_integers(bytes(d), e, bool(s)) for d, e, s in zip(data, encoding, signed, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_bytes(data: pd.Series) -> pd.Series:
    """All bytes (0 to 255) of byte runs."""
    return pd.Series([None if d is None else rle.decode_bytes(bytes(d)).astype("int32") for d in data])


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def decode_booleans(data: pd.Series, count: pd.Series) -> pd.Series:
    """`count` bits of byte runs."""
    return pd.Series([None if d is None else rle.decode_booleans(bytes(d), int(n)) for d, n in zip(data, count, strict=True)])


@F.pandas_udf(T.BinaryType())
def decompress_blocks(data: pd.Series, codec: pd.Series, block_size: pd.Series) -> pd.Series:
    """The bytes of a framed stream; codec is NONE, ZLIB, SNAPPY, LZ4 or ZSTD."""
    return pd.Series([None if d is None else Compression(COMPRESSIONS.index(c), int(n)).read(bytes(d)) for d, c, n in zip(data, codec, block_size, strict=True)])
