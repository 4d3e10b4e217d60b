"""Compression codecs of ORC files and the framing of their blocks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa

from .errors import MalformedStream, UnsupportedFeature
from .wire import COMPRESSIONS, read_varint

#: (compressed block, most bytes that it can give) -> bytes
Codec = Callable[[bytes, int], bytes]


def _zlib(block: bytes, most: int) -> bytes:
    engine = zlib.decompressobj(-15)
    out = engine.decompress(block, most + 1)
    if len(out) > most or not engine.eof:
        raise MalformedStream("deflated data does not end within a block")
    return out


def _snappy(block: bytes, most: int) -> bytes:
    size, _ = read_varint(block, 0)
    if size > most:
        raise MalformedStream("snappy data is longer than a block")
    return pa.decompress(block, decompressed_size=size, codec="snappy", asbytes=True)


def _zstd(block: bytes, most: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(block, max_output_size=most)


def lz4_block(block: bytes, most: int) -> bytes:
    """One LZ4 block: literals and copies of what came before, until the block ends."""
    out, at, n = bytearray(), 0, len(block)

    def length(base: int, at: int) -> tuple[int, int]:
        if base == 15:
            while True:
                if at >= n:
                    raise MalformedStream("an LZ4 length does not end")
                base += block[at]
                at += 1
                if block[at - 1] != 255:
                    break
        return base, at

    while at < n:
        token = block[at]
        literals, at = length(token >> 4, at + 1)
        if at + literals > n:
            raise MalformedStream("LZ4 literals reach beyond the block")
        out += block[at : at + literals]
        at += literals
        if at < n:
            if at + 2 > n:
                raise MalformedStream("an LZ4 offset is cut short")
            back = block[at] | block[at + 1] << 8
            copies, at = length(token & 15, at + 2)
            copies += 4
            if not 0 < back <= len(out):
                raise MalformedStream("an LZ4 offset reaches before the block")
            piece = bytes(out[-back:])
            out += (piece * (copies // back + 1))[:copies]
        if len(out) > most:
            raise MalformedStream("LZ4 data is longer than a block")
    return bytes(out)


DEFAULT_CODECS: dict[str, Codec] = {"ZLIB": _zlib, "SNAPPY": _snappy, "LZ4": lz4_block, "ZSTD": _zstd}


class Compression:
    """How a file's streams are compressed. `codecs` replaces or adds codecs by name."""

    def __init__(self, kind: int, block_size: int, codecs: Mapping[str, Codec] | None = None):
        self.name = COMPRESSIONS[kind] if 0 <= kind < len(COMPRESSIONS) else f"#{kind}"
        self.block_size = block_size or 256 << 10
        known = {**DEFAULT_CODECS, **(codecs or {})}
        if self.name != "NONE" and self.name not in known:
            raise UnsupportedFeature(f"compression {self.name}")
        self.codec = known.get(self.name)

    def read(self, stream: bytes) -> bytes:
        """The bytes of a whole stream. Each block has three bytes before it: its length, shifted by one, and whether it is stored as it is."""
        return b"".join(self.pieces(iter([bytes(stream)])))

    def pieces(self, raw: Iterator[bytes]) -> Iterator[bytes]:
        """The stream's bytes block by block, from pieces of any size of what the file holds."""
        if self.name == "NONE":
            yield from raw
            return
        held, at = b"", 0

        def ahead(n: int) -> bool:
            nonlocal held, at
            parts = [held[at:]] if len(held) - at < n else []
            size = sum(map(len, parts))
            while parts and size < n and (more := next(raw, None)) is not None:
                parts.append(more)
                size += len(more)
            if parts:
                held, at = b"".join(parts), 0
            return len(held) - at >= n

        while ahead(1):
            if not ahead(3):
                raise MalformedStream("a block header is cut short")
            head = int.from_bytes(held[at : at + 3], "little")
            size, stored = head >> 1, head & 1
            at += 3
            if not ahead(size):
                raise MalformedStream("a block reaches beyond its stream")
            block = held[at : at + size]
            try:
                out = block if stored else self.codec(block, self.block_size)
            except MalformedStream:
                raise
            except Exception as e:
                raise MalformedStream(f"{self.name}: {e}") from e
            at += size
            yield out


def frame(data: bytes, block_size: int, compress: Callable[[bytes], bytes]) -> bytes:
    """The stream of blocks that holds data; blocks that do not shrink are stored as they are."""
    out = []
    for at in range(0, len(data), block_size):
        block = data[at : at + block_size]
        small = compress(block)
        stored = len(small) >= len(block)
        body = block if stored else small
        out += [(len(body) << 1 | stored).to_bytes(3, "little"), body]
    return b"".join(out)
