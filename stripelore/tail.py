"""Metadata of one ORC file: its tail, stripe footers and indexes, read by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from . import wire
from .codecs import Codec, Compression
from .errors import InvalidStreamKind, InvalidStripeIndex, InvalidTail, MalformedStream, UnexpectedEof, UnsupportedFeature

#: (place, length) -> bytes, fewer only at the end
ReadAt = Callable[[int, int], bytes]
#: The first read takes so much of the end of the file.
READ_AHEAD = 16 << 10
#: Streams are read in pieces of so many bytes.
PIECE = 256 << 10


def bytes_source(data: bytes) -> tuple[ReadAt, int]:
    return (lambda at, n: data[at : at + n]), len(data)


def part_of(read: ReadAt, start: int, end: int) -> tuple[ReadAt, int]:
    """A file that lies within another one, from start to before end."""
    if not 0 <= start < end:
        raise ValueError(f"no file from {start} to {end}")
    return (lambda at, n: read(start + at, max(0, min(n, end - start - at)))), end - start


def open_source(path: str, start: int = 0, end: int | None = None):
    """(read_at, length, close) of a local path or of a URI that pyarrow's file systems know."""
    import pyarrow.fs as pafs

    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        system, inner = pafs.LocalFileSystem(), path
    f = system.open_input_file(inner)
    size = whole = f.size()
    read: ReadAt = lambda at, n: f.read_at(max(0, min(n, whole - at)), at)
    if start or end is not None:
        read, size = part_of(read, start, size if end is None else end)
    return read, size, f.close


@dataclass
class FileTail:
    read_at: ReadAt = field(repr=False)
    size: int = 0
    codecs: Mapping[str, Codec] | None = None
    postscript: dict[str, Any] = field(default_factory=dict)
    footer: dict[str, Any] = field(default_factory=dict)
    compression: Compression | None = None
    metadata_raw: bytes = b""
    _footers: dict[int, dict] = field(default_factory=dict, repr=False)
    _streams: dict[int, list[dict]] = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, read_at: ReadAt, size: int, codecs: Mapping[str, Codec] | None = None, read_ahead: int = READ_AHEAD) -> FileTail:
        if size < 4:
            raise UnexpectedEof("a file of fewer than 4 bytes")
        ahead = min(size, max(256, read_ahead))
        end = read_at(size - ahead, ahead)
        if len(end) < ahead:
            raise UnexpectedEof("the file is shorter than it seemed")
        n = end[-1]
        if n + 1 > len(end):
            raise InvalidTail("the postscript is longer than the file")
        postscript = wire.decode(end[-1 - n : -1], wire.POSTSCRIPT)
        if postscript.get("magic") != "ORC":
            raise InvalidTail("the postscript does not say ORC")
        footer_length, metadata_length = postscript.get("footer_length", 0), postscript.get("metadata_length", 0)
        whole = 1 + n + footer_length + metadata_length
        if whole >= size:
            raise InvalidTail(f"a tail of {whole} bytes in a file of {size}")
        if whole > len(end):
            end = read_at(size - whole, whole)
        tail = cls(read_at, size, codecs, postscript)
        tail.compression = Compression(postscript.get("compression", 0), postscript.get("block_size", 0), codecs)
        body = end[len(end) - whole : len(end) - 1 - n]
        tail.metadata_raw = body[:metadata_length]
        tail.footer = wire.decode(tail.compression.read(body[metadata_length:]), wire.FOOTER)
        if tail.footer.get("encryption"):
            raise UnsupportedFeature("encrypted files")
        return tail

    @property
    def version(self) -> tuple[int, int]:
        major, minor, *_ = [*self.postscript["version"], 0, 0]
        return major, minor

    @property
    def rows(self) -> int:
        return self.footer.get("rows", 0)

    @property
    def types(self) -> list[dict]:
        return self.footer["types"]

    @property
    def user_metadata(self) -> dict[str, bytes]:
        return {x.get("name", ""): x.get("value", b"") for x in self.footer["metadata"]}

    @property
    def stripes(self) -> list[dict]:
        return self.footer["stripes"]

    @property
    def nullable(self) -> dict[int, bool]:
        return {i: bool(s.get("has_null", True)) for i, s in enumerate(self.footer["statistics"])}

    @cached_property
    def stripe_statistics(self) -> list[list[dict]]:
        """For each stripe, statistics by column id; empty where the file has none."""
        if not self.metadata_raw:
            return []
        return [s["columns"] for s in wire.decode(self.compression.read(self.metadata_raw), wire.METADATA)["stripes"]]

    def stripe(self, i: int) -> dict:
        if not 0 <= i < len(self.stripes):
            raise InvalidStripeIndex(f"stripe {i} of {len(self.stripes)}")
        return self.stripes[i]

    def stripe_footer(self, i: int) -> dict:
        """Read once for each stripe."""
        if i in self._footers:
            return self._footers[i]
        s = self.stripe(i)
        at = s.get("offset", 0) + s.get("index_length", 0) + s.get("data_length", 0)
        raw = self.read_at(at, s.get("footer_length", 0))
        if len(raw) < s.get("footer_length", 0):
            raise UnexpectedEof(f"the footer of stripe {i} is cut short")
        self._footers[i] = wire.decode(self.compression.read(raw), wire.STRIPE_FOOTER)
        return self._footers[i]

    def streams(self, i: int) -> list[dict]:
        """kind, column, offset and length of each stream of a stripe, in their order."""
        if i in self._streams:
            return self._streams[i]
        s, out = self.stripe(i), []
        at = s.get("offset", 0)
        end = at + s.get("index_length", 0) + s.get("data_length", 0)
        for x in self.stripe_footer(i)["streams"]:
            length, n = x.get("length", 0), x.get("kind", 0)
            if at + length > end:
                raise MalformedStream(f"a stream of stripe {i} reaches beyond it")
            out.append({"kind": wire.STREAMS[n] if n < len(wire.STREAMS) else f"#{n}", "column": x.get("column", 0), "offset": at, "length": length})
            at += length
        self._streams[i] = out
        return out

    def stream(self, i: int, column: int, kind: str) -> bytes:
        """The decompressed bytes of one stream."""
        return b"".join(self.pieces(i, column, kind))

    def pieces(self, i: int, column: int, kind: str) -> Iterator[bytes]:
        """The same, block by block; the file is read in pieces of PIECE bytes."""
        found = next((x for x in self.streams(i) if (x["column"], x["kind"]) == (column, kind)), None)
        if found is None:
            raise InvalidStreamKind(f"column {column} has no {kind} stream in stripe {i}")
        yield from self.compression.pieces(self._raw(found, f"the {kind} stream of column {column} in stripe {i}"))

    def _raw(self, stream: dict, name: str) -> Iterator[bytes]:
        for at in range(0, stream["length"], PIECE):
            n = min(PIECE, stream["length"] - at)
            raw = self.read_at(stream["offset"] + at, n)
            if len(raw) < n:
                raise UnexpectedEof(f"{name} is cut short")
            yield raw

    def encoding(self, i: int, column: int) -> str:
        return wire.ENCODINGS[self.stripe_footer(i)["columns"][column].get("kind", 0)]

    def row_index(self, i: int, column: int) -> list[dict]:
        """Positions and statistics of each group of rows."""
        return wire.decode(self.stream(i, column, "ROW_INDEX"), wire.ROW_INDEX)["entries"]

    def bloom_filters(self, i: int, column: int) -> list[dict]:
        """hashes and bits (bytes) of each group of rows; only filters over UTF-8 whose encoding says so are read, of others there are none."""
        if self.stripe_footer(i)["columns"][column].get("bloom_encoding", 0) != 1:
            return []
        filters = wire.decode(self.stream(i, column, "BLOOM_FILTER_UTF8"), wire.BLOOM_INDEX)["filters"]
        for f in filters:
            if not f.get("hashes") or "utf8bitset" not in f:
                raise MalformedStream("a Bloom filter without hashes or bits")
        return [{"hashes": f["hashes"], "bits": f["utf8bitset"]} for f in filters]
