"""Texts and other bytes as PNG images in binary columns, read back with checks, and cosine-transform hashes of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a row: 64 pixels of three 8-bit samples.
ROW = 192


class MediaError(ValueError):
    """A file that is not a whole and valid PNG of the kind read here."""


def pad(payload: bytes, to: int = ROW) -> bytes:
    """The payload with spaces behind it, up to a positive multiple of `to` bytes."""
    return payload + b" " * (-len(payload) % to if payload else to)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: np.ndarray, level: int = 6, filters: np.ndarray | None = None) -> bytes:
    """8-bit samples (rows x pixels x channels, 1 or 3) as PNG. `filters` has a filter type for each row; without
    it each row gets, of none, left and above, the one whose differences have the least sum of magnitudes."""
    rows, width, channels = samples.shape
    flat = samples.reshape(rows, width * channels)
    left = np.zeros_like(flat)
    left[:, channels:] = flat[:, :-channels]
    above = np.zeros_like(flat)
    above[1:] = flat[:-1]
    if filters is None:
        made = [flat, flat - left, flat - above]
        cost = np.stack([np.minimum(x, 0 - x).sum(1, dtype=np.int64) for x in made])
        filters = cost.argmin(0).astype(np.uint8)
        body = np.choose(filters[:, None], made)
    else:
        corner = np.zeros_like(flat)
        corner[1:, channels:] = flat[:-1, :-channels]
        a, b, c = (x.astype(np.int16) for x in (left, above, corner))
        mean = ((a + b) >> 1).astype(np.uint8)
        body = np.choose(filters[:, None], [flat, flat - left, flat - above, flat - mean, flat - _nearest(a, b, c)])
    raw = np.concatenate([np.asarray(filters, np.uint8)[:, None], body], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, rows, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner the one nearest to left + above - corner, in this order (int16 in, uint8 out)."""
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def chunks_of(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG file, each with its checksum tested."""
    if png[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(png):
            raise MediaError("the file ends within a chunk")
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(png):
            raise MediaError("the file ends within a chunk")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r} is wrong")
        yield kind, data
        at += 12 + n


def read_png(png: bytes) -> np.ndarray:
    """Samples (rows x pixels x channels) of an 8-bit grey or RGB PNG without interlacing."""
    head, data = None, []
    for kind, body in chunks_of(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        raise MediaError("not an 8-bit grey or RGB image without interlacing")
    width, rows, channels = head[0], head[1], 3 if head[3] == 2 else 1
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise MediaError(f"image data: {e}") from e
    if len(raw) != rows * (1 + width * channels):
        raise MediaError("image data of the wrong length")
    raw = raw.reshape(rows, 1 + width * channels)
    if rows and raw[:, 0].max() > 4:
        raise MediaError("unknown filter type")
    return unfilter(raw[:, 0], raw[:, 1:].reshape(rows, width, channels))


def unfilter(filters: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Undoes the row filters. Rows of types none, left and above are done together: sums along the row, then sums down each
    run of above-rows, all modulo 256. Types mean and nearest need their neighbours' results and go pixel by pixel."""
    rows, width, _ = body.shape
    out = body.copy()
    side = filters == 1
    out[side] = np.cumsum(body[side], axis=1, dtype=np.uint8)
    hard = np.flatnonzero(filters > 2)
    first = 0
    for h in [*hard.tolist(), rows]:
        _down(out, filters, first, h)
        if h < rows:
            above = out[h - 1].astype(np.int16) if h else np.zeros_like(out[0], np.int16)
            left = corner = np.zeros(body.shape[2], np.int16)
            for x in range(width):
                guess = (left + above[x]) >> 1 if filters[h] == 3 else _nearest(left, above[x], corner)
                out[h, x] = body[h, x] + guess.astype(np.uint8)
                left, corner = out[h, x].astype(np.int16), above[x]
        first = h + 1
    return out


def _down(out: np.ndarray, filters: np.ndarray, first: int, last: int) -> None:
    """Rows first to last, in place: adds to above-rows what stands above them."""
    if first >= last or not (filters[first:last] == 2).any():
        return
    part, up = out[first:last], filters[first:last] == 2
    sums = np.cumsum(np.where(up[:, None, None], part, 0), axis=0, dtype=np.uint8)
    base = np.maximum.accumulate(np.where(up, -1, np.arange(last - first)))
    top = out[first - 1] if first else np.zeros_like(out[0])
    start = np.where((base >= 0)[:, None, None], part[base], top)
    used = np.where((base >= 0)[:, None, None], sums[base], 0).astype(np.uint8)
    part[up] = (start + sums - used)[up]


_SIDE, _LOW = 32, 8
_COSINE = np.cos(np.pi * (np.arange(_SIDE)[None, :] + 0.5) * np.arange(_LOW)[:, None] / _SIDE)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the image, taken down to 32 x 32, are above their median."""
    flat = samples.reshape(samples.shape[0], -1).astype(np.float64)
    for axis in (0, 1):
        n = flat.shape[axis]
        edges = np.arange(_SIDE) * n // _SIDE
        if n >= _SIDE:
            sizes = np.diff(np.append(edges, n))
            flat = np.add.reduceat(flat, edges, axis=axis) / (sizes[:, None] if axis == 0 else sizes[None, :])
        else:
            flat = np.take(flat, edges, axis=axis)
    low = (_COSINE @ flat @ _COSINE.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def to_media(docs: DataFrame, level: int = 6) -> DataFrame:
    """doc_id, n_bytes and media, no other columns: the UTF-8 bytes of each whole text, of any length, padded with spaces to rows of 192, as
    an RGB PNG 64 pixels wide. Null is an empty text, one row of spaces. One row for each row, repeated ones too, and equal texts
    give equal images; an empty table stays empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _lots(batch.column("text")):
                raw = [(t.as_py() or "").encode("utf-8") for t in batch.column("text").slice(first, last - first)]
                media = [write_png(np.frombuffer(pad(x), np.uint8).reshape(-1, ROW // 3, 3), level) for x in raw]
                columns = [batch.column("doc_id").slice(first, last - first), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, T.StructType(fields))


def _lots(column: pa.Array, most: int = 256, size: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) of rows in a row, up to `most` of them and about `size` bytes, one at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and (i - first == most or held + n > size):
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds (or replaces) payload (the samples' bytes, read back with every checksum tested) and hash (the cosine hash, 8 bytes).
    Null media give nulls; a file that is not a valid PNG raises MediaError. The other columns pass, whatever their names; one row for each
    row, and an empty table stays empty."""
    rest = [c for c in media.columns if c not in ("payload", "hash", column)]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    named = media.select(row, F.col(f"`{column}`").alias("media"))
    schema = T.StructType([T.StructField("row", named.schema["row"].dataType), T.StructField("media", named.schema["media"].dataType), T.StructField("payload", T.BinaryType()), T.StructField("hash", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _lots(batch.column("media")):
                part = batch.slice(first, last - first)
                images = [None if x.as_py() is None else read_png(x.as_py()) for x in part.column("media")]
                payload = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
                hashes = pa.array([None if x is None else cosine_hash(x) for x in images], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("media"), payload, hashes], ["row", "media", "payload", "hash"])

    kept = [F.col("media").alias(c) if c == column else F.col(f"row.`{c}`") for c in media.columns if c not in ("payload", "hash")]
    return map_arrow(named, run, schema).select(*kept, "payload", "hash")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the texts of all documents as PNG and reads them back."""
    back = read_media(to_media(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )
