"""Decoding of the metadata messages of ORC files from the protocol-buffer wire format."""

from __future__ import annotations

import struct
from typing import Any

from .errors import CorruptedProtobuf


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptedProtobuf("a variable-length number does not end")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def unzigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# Fixed values of the ORC format: field numbers, names and kinds. A list means a repeated field, a dict a message.
INTEGER = {1: ("min", "sint"), 2: ("max", "sint"), 3: ("sum", "sint")}
DOUBLE = {1: ("min", "double"), 2: ("max", "double"), 3: ("sum", "double")}
STRING = {1: ("min", "string"), 2: ("max", "string"), 3: ("sum", "sint"), 4: ("lower", "string"), 5: ("upper", "string")}
BUCKET = {1: ("count", ["uint"])}
DECIMAL = {1: ("min", "string"), 2: ("max", "string"), 3: ("sum", "string")}
DATE = {1: ("min", "sint"), 2: ("max", "sint")}
BINARY = {1: ("sum", "sint")}
TIMESTAMP = {1: ("min", "sint"), 2: ("max", "sint"), 3: ("min_utc", "sint"), 4: ("max_utc", "sint"), 5: ("min_nanos", "int"), 6: ("max_nanos", "int")}
COLLECTION = {1: ("min_children", "uint"), 2: ("max_children", "uint"), 3: ("total_children", "uint")}
COLUMN_STATISTICS = {
    1: ("values", "uint"), 2: ("integer", INTEGER), 3: ("double", DOUBLE), 4: ("string", STRING), 5: ("bucket", BUCKET), 6: ("decimal", DECIMAL),
    7: ("date", DATE), 8: ("binary", BINARY), 9: ("timestamp", TIMESTAMP), 10: ("has_null", "bool"), 11: ("bytes_on_disk", "uint"), 12: ("collection", COLLECTION),
}
POSTSCRIPT = {
    1: ("footer_length", "uint"), 2: ("compression", "uint"), 3: ("block_size", "uint"), 4: ("version", ["uint"]), 5: ("metadata_length", "uint"),
    6: ("writer_version", "uint"), 7: ("stripe_statistics_length", "uint"), 8000: ("magic", "string"),
}
STRIPE = {1: ("offset", "uint"), 2: ("index_length", "uint"), 3: ("data_length", "uint"), 4: ("footer_length", "uint"), 5: ("rows", "uint"), 6: ("encrypt_id", "uint")}
PAIR = {1: ("key", "string"), 2: ("value", "string")}
TYPE = {
    1: ("kind", "uint"), 2: ("subtypes", ["uint"]), 3: ("names", ["string"]), 4: ("maximum_length", "uint"), 5: ("precision", "uint"), 6: ("scale", "uint"),
    7: ("attributes", [PAIR]),
}
USER_ITEM = {1: ("name", "string"), 2: ("value", "bytes")}
FOOTER = {
    1: ("header_length", "uint"), 2: ("content_length", "uint"), 3: ("stripes", [STRIPE]), 4: ("types", [TYPE]), 5: ("metadata", [USER_ITEM]), 6: ("rows", "uint"),
    7: ("statistics", [COLUMN_STATISTICS]), 8: ("row_index_stride", "uint"), 9: ("writer", "uint"), 10: ("encryption", "bytes"), 11: ("calendar", "uint"),
    12: ("software_version", "string"),
}
METADATA = {1: ("stripes", [{1: ("columns", [COLUMN_STATISTICS])}])}
STREAM = {1: ("kind", "uint"), 2: ("column", "uint"), 3: ("length", "uint")}
ENCODING = {1: ("kind", "uint"), 2: ("dictionary_size", "uint"), 3: ("bloom_encoding", "uint")}
STRIPE_FOOTER = {1: ("streams", [STREAM]), 2: ("columns", [ENCODING]), 3: ("timezone", "string")}
ROW_INDEX = {1: ("entries", [{1: ("positions", ["uint"]), 2: ("statistics", COLUMN_STATISTICS)}])}
BLOOM_INDEX = {1: ("filters", [{1: ("hashes", "uint"), 2: ("bitset", ["fixed"]), 3: ("utf8bitset", "bytes")}])}
# Fixed values of the ORC format: enumerations, in the order of their numbers.
COMPRESSIONS = ["NONE", "ZLIB", "SNAPPY", "LZO", "LZ4", "ZSTD", "BROTLI"]
TYPES = ["BOOLEAN", "BYTE", "SHORT", "INT", "LONG", "FLOAT", "DOUBLE", "STRING", "BINARY", "TIMESTAMP", "LIST", "MAP", "STRUCT", "UNION", "DECIMAL", "DATE", "VARCHAR", "CHAR", "TIMESTAMP_INSTANT"]
STREAMS = ["PRESENT", "DATA", "LENGTH", "DICTIONARY_DATA", "DICTIONARY_COUNT", "SECONDARY", "ROW_INDEX", "BLOOM_FILTER", "BLOOM_FILTER_UTF8", "ENCRYPTED_INDEX", "ENCRYPTED_DATA"]
ENCODINGS = ["DIRECT", "DICTIONARY", "DIRECT_V2", "DICTIONARY_V2"]


def _scalar(kind: str, wire: int, raw: Any) -> Any:
    if kind in ("string", "bytes"):
        if wire != 2:
            raise CorruptedProtobuf(f"{kind} with wire type {wire}")
        return bytes(raw).decode("utf-8", "replace") if kind == "string" else bytes(raw)
    if kind == "double":
        if wire != 1:
            raise CorruptedProtobuf(f"double with wire type {wire}")
        return struct.unpack("<d", raw)[0]
    if kind == "fixed":
        return struct.unpack("<Q", raw)[0]
    if wire != 0:
        raise CorruptedProtobuf(f"number with wire type {wire}")
    return {"uint": int, "int": _signed, "sint": unzigzag, "bool": bool}[kind](raw)


def _packed(kind: str, raw: bytes) -> list:
    if kind == "fixed":
        return list(struct.unpack(f"<{len(raw) // 8}Q", raw))
    out, at = [], 0
    while at < len(raw):
        value, at = read_varint(raw, at)
        out.append(_scalar(kind, 0, value))
    return out


def decode(data: bytes, message: dict) -> dict[str, Any]:
    """Fields of a message by name; repeated ones are lists (empty if absent), absent others are not there."""
    out: dict[str, Any] = {name: [] for name, kind in message.values() if isinstance(kind, list)}
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            raw, at = read_varint(data, at)
        elif wire in (1, 5, 2):
            n = {1: 8, 5: 4}.get(wire)
            if n is None:
                n, at = read_varint(data, at)
            raw, at = data[at : at + n], at + n
            if at > len(data):
                raise CorruptedProtobuf("a field reaches beyond its message")
        else:
            raise CorruptedProtobuf(f"unknown wire type {wire}")
        if number not in message:
            continue
        name, kind = message[number]
        one = kind[0] if isinstance(kind, list) else kind
        if isinstance(one, dict):
            if wire != 2:
                raise CorruptedProtobuf(f"message with wire type {wire}")
            value = decode(raw, one)
        elif isinstance(kind, list) and wire == 2 and one not in ("string", "bytes"):
            out[name] += _packed(one, raw)
            continue
        else:
            value = _scalar(one, wire, raw)
        if isinstance(kind, list):
            out[name].append(value)
        else:
            out[name] = value
    return out
