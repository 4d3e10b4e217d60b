"""Columns decoded from their streams, by hand: what the vectorized reader does, where its steps are of interest."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import rle
from ..codecs import Codec
from ..errors import ColumnLengthNotEqual, MalformedDictionary, MalformedPresentOrData, MalformedUnion, TypeNotSupported
from ..shipping import ship_package
from ..sources import register
from ..sources.files import packed_codecs
from ..tail import FileTail, open_source
from ..wire import TYPES

#: Seconds from 1970 to 2015 in UTC; timestamps are counted from 2015 on in their writer's time zone.
EPOCH = 1420070400
#: Rows that are decoded at a time.
ROWS = 1 << 15


def timestamp_nanos(seconds: np.ndarray, coded: np.ndarray, zone: str = "UTC") -> np.ndarray:
    """Nanoseconds since 1970 of what the writer's clock in its zone showed. The low three bits of coded nanoseconds say, if not 0, one less
    than how many zeros were cut off."""
    zeros, nanos = coded & 7, coded >> 3
    nanos = np.where(zeros > 0, nanos * 10 ** np.where(zeros > 0, zeros + 1, 0), nanos)
    whole = seconds + EPOCH
    if zone not in ("", "UTC", "GMT", "Etc/UTC"):
        whole = whole - _offsets(np.array([EPOCH]), zone)[0]  # 2015 began so much later or earlier there
    # before 1970 the writer rounds seconds towards zero, so that a fraction belongs to the second before
    whole = np.where((whole < 0) & (nanos > 999_999), whole - 1, whole)
    if zone not in ("", "UTC", "GMT", "Etc/UTC"):
        whole = whole + _offsets(whole, zone)
    return whole * 1_000_000_000 + nanos


def _offsets(seconds: np.ndarray, zone: str) -> np.ndarray:
    """A zone's seconds ahead of UTC at each time, looked up once for each quarter of an hour that comes up."""
    quarters, place = np.unique(seconds // 900, return_inverse=True)
    tz, start = ZoneInfo(zone), datetime(1970, 1, 1, tzinfo=UTC)
    ahead = [(start + timedelta(seconds=int(q) * 900)).astimezone(tz).utcoffset().total_seconds() for q in quarters.tolist()]
    return np.array(ahead, np.int64)[place]


def _cut(sizes: np.ndarray, data: bytes, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _decimals(parts: list[np.ndarray], scales: np.ndarray, kind: pa.Decimal128Type) -> pa.Array:
    """Zigzag numbers and the scale of each -> decimals; in numpy if they keep within 18 digits."""
    off = kind.scale - scales
    if all(p.dtype == np.uint64 for p in parts) and len(off) and 0 <= off.min() and off.max() <= 18:
        v, factor = rle.unzigzag(np.concatenate(parts)), 10 ** off.astype(np.int64)
        if (np.abs(v) <= (10 ** min(18, kind.precision) - 1) // factor).all():
            v = v * factor
            return pa.Array.from_buffers(kind, len(v), [None, pa.py_buffer(np.stack((v, v >> 63), axis=1).tobytes())])
    numbers = [v >> 1 ^ -(v & 1) for p in parts for v in p.tolist()]
    return pa.array([Decimal(v).scaleb(-s) for v, s in zip(numbers, scales.tolist(), strict=True)], kind)


class _Values:
    """A column of one stripe, from the first row on in the numbers of rows asked for; streams are opened when values are."""

    def __init__(self, tail: FileTail, i: int, c: int):
        self.tail, self.i, self.c, self.t = tail, i, c, tail.types[c]
        self.kind, self.encoding = TYPES[self.t.get("kind", 0)], tail.encoding(i, c)
        self.there = rle.Booleans(self._feed("PRESENT")) if any((x["column"], x["kind"]) == (c, "PRESENT") for x in tail.streams(i)) else None
        self.children = [_Values(tail, i, s) for s in self.t.get("subtypes", ())]
        self.words: pa.Array | None = None
        self.data, kind, encoding = self._feed("DATA"), self.kind, self.encoding
        if kind == "BOOLEAN":
            self.numbers = rle.Booleans(self.data)
        elif kind in ("BYTE", "UNION"):
            self.numbers = rle.byte_values(self.data)
        else:
            self.numbers = rle.integers(self.data, encoding, not encoding.startswith("DICTIONARY"))
        self.lengths = rle.integers(self._feed("LENGTH"), encoding, False)
        self.second = rle.integers(self._feed("SECONDARY"), encoding, kind == "DECIMAL")

    def _feed(self, kind: str) -> rle.Feed:
        return rle.Feed(self.tail.pieces(self.i, self.c, kind))

    def take(self, rows: int) -> pa.Array:
        """The next rows below the parents; nulls where presence bits say so."""
        there = None if self.there is None else self.there.take(rows)
        values = self._values(rows if there is None else int(there.sum()))
        return values if there is None else _spread(values, there)

    def end(self) -> None:
        """After the last row: what is too much."""
        if self.kind == "DECIMAL" and self.data.at and self.data.ahead():
            raise MalformedPresentOrData("more decimals are there than were expected")
        for child in self.children:
            child.end()

    def _strings(self, n: int, kind: pa.DataType) -> pa.Array:
        if self.encoding.startswith("DICTIONARY"):
            if self.words is None:
                size = self.tail.stripe_footer(self.i)["columns"][self.c].get("dictionary_size", 0)
                sizes = self.lengths.take(size)
                data = self.tail.stream(self.i, self.c, "DICTIONARY_DATA") if size else b""
                if int(sizes.sum()) > len(data):
                    raise MalformedDictionary("entries reach beyond the dictionary")
                self.words = _cut(sizes, data, kind)
            at = self.numbers.take(n)
            if len(at) and (at.min() < 0 or at.max() >= len(self.words)):
                raise MalformedDictionary("an index beyond the dictionary")
            return self.words.take(pa.array(at))
        sizes = self.lengths.take(n)
        whole = int(sizes.sum())
        data = self.data.take(whole) if whole else b""
        if whole > len(data):
            raise MalformedPresentOrData("values reach beyond their stream")
        return _cut(sizes, data, kind)

    def _values(self, n: int) -> pa.Array:
        """The next n values that are there."""
        kind, t = self.kind, self.t
        whole = {"SHORT": pa.int16(), "INT": pa.int32(), "LONG": pa.int64(), "DATE": pa.int32()}
        if kind == "BOOLEAN":
            return pa.array(self.numbers.take(n))
        if kind == "BYTE":
            return pa.array(self.numbers.take(n).view(np.int8))
        if kind in whole:
            out = pa.array(self.numbers.take(n)).cast(whole[kind])
            return out.cast(pa.date32()) if kind == "DATE" else out
        if kind in ("FLOAT", "DOUBLE"):
            size = 4 if kind == "FLOAT" else 8
            raw = self.data.take(n * size) if n else b""
            if len(raw) < n * size:
                raise MalformedPresentOrData("values reach beyond their stream")
            return pa.array(np.frombuffer(raw, f"<f{size}", n))
        if kind in ("STRING", "VARCHAR", "CHAR", "BINARY"):
            return self._strings(n, pa.binary() if kind == "BINARY" else pa.string())
        if kind == "DECIMAL":
            parts, scales = self.data.varints(n), self.second.take(n)
            if (there := sum(map(len, parts))) != n:
                raise MalformedPresentOrData(f"{n} decimals were expected, {there} are there")
            return _decimals(parts, scales, pa.decimal128(t.get("precision") or 38, t.get("scale") or 18 * (not t.get("precision"))))
        if kind in ("TIMESTAMP", "TIMESTAMP_INSTANT"):
            if not n:
                return pa.array([], pa.int64())
            zone = "UTC" if kind == "TIMESTAMP_INSTANT" else self.tail.stripe_footer(self.i).get("timezone", "UTC")
            return pa.array(timestamp_nanos(self.numbers.take(n), self.second.take(n), zone))
        if kind == "STRUCT":
            return pa.StructArray.from_arrays([child.take(n) for child in self.children], list(t["names"]))
        if kind in ("LIST", "MAP"):
            sizes = self.lengths.take(n)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            children = [child.take(int(sizes.sum())) for child in self.children]
            return pa.ListArray.from_arrays(offsets, *children) if kind == "LIST" else pa.MapArray.from_arrays(offsets, *children)
        if kind == "UNION":
            tags = self.numbers.take(n)
            if len(tags) and tags.max() >= len(self.children):
                raise MalformedUnion("a tag that no variant of the union has")
            masks = [tags == k for k in range(len(self.children))]
            fields = [_spread(child.take(int(mine.sum())), mine) for child, mine in zip(self.children, masks, strict=True)]
            return pa.StructArray.from_arrays([pa.array(tags.view(np.int8)), *fields], ["tag", *[f"field{k}" for k in range(len(fields))]])
        raise TypeNotSupported(f"{kind} is not read")


def _spread(values: pa.Array, there: np.ndarray) -> pa.Array:
    """Values in the places where they are, nulls elsewhere."""
    at = np.where(there, np.cumsum(there) - 1, 0)
    return values.take(pa.array(at, mask=~there)) if len(values) else pa.nulls(len(there), values.type)


def decode_column(tail: FileTail, stripe: int, column: int) -> pa.Array:
    """A column below the root, of one stripe, with all below it; nulls where presence bits say so. Timestamps are longs of nanoseconds, unions
    structs of tag and fields."""
    values = _Values(tail, stripe, column)
    out = values.take(tail.stripe(stripe).get("rows", 0))
    values.end()
    return out


def read_streams(streams: DataFrame, codecs: Mapping[str, Codec] | None = None) -> DataFrame:
    """Rows of the orc_streams source with data, the stream's decompressed bytes. Executors read no more of a file than its tail, the stripe's
    footer and the stream."""
    ship_package(streams.sparkSession)
    names = streams.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("file", "stripe", "column_id", "stream")], strict=True)
            for n, (file, stripe, column, kind) in enumerate(keys):
                read, size, close = open_source(file)
                data = FileTail.read(read, size, codecs).stream(stripe, column, kind)
                close()
                yield pa.RecordBatch.from_arrays([*batch.slice(n, 1).columns, pa.array([data], pa.binary())], [*names, "data"])

    return streams.mapInArrow(run, T.StructType([*streams.schema.fields, T.StructField("data", T.BinaryType())]))


def read_integers(streams: DataFrame, signed: bool, codecs: Mapping[str, Codec] | None = None) -> DataFrame:
    """Rows of the orc_streams source -> value, one row for each number of these streams, decoded about ROWS numbers at a time by the
    encoding of their column. As read_streams and decode_integers, without a whole stream in memory."""
    ship_package(streams.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, stripe, column, kind, encoding in zip(*[batch.column(c).to_pylist() for c in ("file", "stripe", "column_id", "stream", "encoding")], strict=True):
                read, size, close = open_source(file)
                feed = rle.Feed(FileTail.read(read, size, codecs).pieces(stripe, column, kind))
                for values in rle.integers(feed, encoding, signed).lots(ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(values)], ["value"])
                close()

    return streams.select("file", "stripe", "column_id", "stream", "encoding").mapInArrow(run, "value long")


def decode_columns(spark: SparkSession, path: str, columns: dict[str, str], codecs: Mapping[str, Codec] | None = None) -> DataFrame:
    """Columns of all stripes of a path, decoded by hand: {name: Spark type}, one task for each lot of stripes, which holds ROWS
    rows of a stripe at a time. `codecs` replaces or adds decompressors."""
    register(spark)
    ship_package(spark)
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, stripe in zip(batch.column("file").to_pylist(), batch.column("stripe").to_pylist(), strict=True):
                read, size, close = open_source(file)
                tail = FileTail.read(read, size, codecs)
                ids = dict(zip(tail.types[0]["names"], tail.types[0]["subtypes"], strict=True))
                values = [_Values(tail, stripe, ids[n]) for n in names]
                rows = tail.stripe(stripe).get("rows", 0)
                for at in range(0, rows, ROWS):
                    arrays = [v.take(min(ROWS, rows - at)) for v in values]
                    if len({len(a) for a in arrays}) > 1:
                        raise ColumnLengthNotEqual(f"columns of {sorted({len(a) for a in arrays})} rows")
                    yield pa.RecordBatch.from_arrays(arrays, names)
                for v in values:
                    v.end()
                close()

    source = spark.read.format("orc_stripes").option("path", path)
    stripes = (source.option("codecs", packed_codecs(codecs)) if codecs else source).load().select("file", "stripe")
    return stripes.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in columns.items()))
