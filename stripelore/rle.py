"""Run-length and integer encodings of ORC streams, on numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .errors import MalformedRleBlock

_WRAP = (1 << 64) - 1
# Fixed values of the ORC format: bit widths by their 5-bit code.
WIDTHS = [*range(1, 25), 26, 28, 30, 32, 40, 48, 56, 64]


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed to unsigned: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    v = np.asarray(values, np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.uint64)
    return ((v >> np.uint64(1)) ^ (~(v & np.uint64(1)) + np.uint64(1))).view(np.int64)


def encode_varint(value: int) -> bytes:
    if value < 0:
        raise ValueError("only numbers from 0 on")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number of any size, place behind it)."""
    end = at
    while end < len(data) and data[end] & 0x80:
        end += 1
    if end >= len(data):
        raise MalformedRleBlock("a variable-length number is cut short")
    value = 0
    for byte in reversed(data[at : end + 1]):
        value = value << 7 | byte & 0x7F
    return value, end + 1


def decode_varints(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = decode_varint(data, at)
        out.append(value)
    return out


def coded_big_endian(data: bytes, signed: bool) -> int:
    """A big-endian number, in zigzag form if it has a sign."""
    if not data:
        raise MalformedRleBlock("a number without bytes")
    value = int.from_bytes(data, "big")
    return value >> 1 ^ -(value & 1) if signed else value


def _need(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise MalformedRleBlock("a run is cut short")
    return data[at : at + n]


def _bytes_run(data: bytes, at: int) -> tuple[np.ndarray, int]:
    head = data[at]
    if head < 128:
        return np.full(head + 3, _need(data, at + 1, 1)[0], np.uint8), at + 2
    part = np.frombuffer(_need(data, at + 1, 256 - head), np.uint8)
    return part, at + 1 + len(part)


def _all(run, data: bytes, count: int | None, kind) -> np.ndarray:
    """The numbers of all runs, or the first `count`."""
    out, at, n = [], 0, 0
    while at < len(data) and (count is None or n < count):
        part, at = run(data, at)
        out.append(part)
        n += len(part)
    return _first(out, n, count, kind)


def decode_bytes(data: bytes, count: int | None = None) -> np.ndarray:
    """Byte runs: a header from 0 on repeats the next byte header + 3 times, a negative one stands before -header bytes."""
    return _all(_bytes_run, data, count, np.uint8)


def encode_bytes(values: np.ndarray) -> bytes:
    """Byte runs of three or more, literals between."""
    data = np.asarray(values, np.uint8).tobytes()
    out, literal, at = bytearray(), bytearray(), 0

    def flush() -> None:
        while literal:
            part = literal[:128]
            out.append(256 - len(part))
            out.extend(part)
            del literal[:128]

    while at < len(data):
        end = at
        while end < len(data) and data[end] == data[at] and end - at < 130:
            end += 1
        if end - at >= 3:
            flush()
            out += bytes((end - at - 3, data[at]))
            at = end
        else:
            literal.append(data[at])
            at += 1
    flush()
    return bytes(out)


def decode_booleans(data: bytes, count: int) -> np.ndarray:
    """`count` bits of byte runs, the highest bit of each byte first."""
    packed = decode_bytes(data, (count + 7) // 8)
    return np.unpackbits(packed)[:count].astype(bool)


def encode_booleans(values: np.ndarray) -> bytes:
    return encode_bytes(np.packbits(np.asarray(values, bool)))


def _first(parts: list[np.ndarray], n: int, count: int | None, kind) -> np.ndarray:
    if count is not None and n < count:
        raise MalformedRleBlock(f"{count} values were expected, {n} are there")
    out = np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
    return out if count is None else out[:count]


def _int64(value: int) -> int:
    value &= _WRAP
    return value - (1 << 64) if value >> 63 else value


def _v1_run(data: bytes, at: int, signed: bool) -> tuple[np.ndarray, int]:
    head = data[at]
    if head < 128:
        step = int.from_bytes(_need(data, at + 1, 1), "big", signed=True)
        base, at = decode_varint(data, at + 2)
        base = base >> 1 ^ -(base & 1) if signed else base
        with np.errstate(over="ignore"):
            return np.int64(_int64(base)) + np.arange(head + 3, dtype=np.int64) * np.int64(step), at
    values, at = [], at + 1
    for _ in range(256 - head):
        v, at = decode_varint(data, at)
        values.append(_int64(v >> 1 ^ -(v & 1) if signed else v))
    return np.array(values, np.int64), at


def decode_v1(data: bytes, signed: bool, count: int | None = None) -> np.ndarray:
    """Version 1: a header from 0 on has header + 3 numbers a fixed step (one signed byte) apart, a negative one -header numbers as they are.
    Unsigned numbers above 2**63 - 1 come out as their 64-bit pattern; sums wrap."""
    return _all(lambda d, at: _v1_run(d, at, signed), data, count, np.int64)


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """n big-endian numbers of `width` bits each, as 64-bit patterns."""
    if not n or not width:
        return np.zeros(n, np.uint64)
    size = (width * n + 7) // 8
    if len(data) < size:
        raise MalformedRleBlock("packed numbers are cut short")
    if width in (8, 16, 32, 64):
        return np.frombuffer(data[:size], f">u{width // 8}").astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(data[:size], np.uint8))[: width * n].reshape(n, width)
    whole = np.zeros((n, 64), np.uint8)
    whole[:, 64 - width :] = bits
    return np.packbits(whole, axis=1).view(">u8").ravel().astype(np.uint64)


def _packed_size(width: int, n: int) -> int:
    return (width * n + 7) // 8


def _v2_run(data: bytes, at: int, signed: bool) -> tuple[np.ndarray, int]:
    kind = data[at] >> 6
    if kind == 2:
        return _patched(data, at)
    return (_short_repeat, _direct, None, _delta)[kind](data, at, signed)


def decode_v2(data: bytes, signed: bool, count: int | None = None) -> np.ndarray:
    """Version 2: short repeats, directly packed numbers, patched bases and deltas, told apart by the two highest bits of each header."""
    return _all(lambda d, at: _v2_run(d, at, signed), data, count, np.int64)


def _short_repeat(data: bytes, at: int, signed: bool) -> tuple[np.ndarray, int]:
    size = (data[at] >> 3 & 7) + 1
    value = coded_big_endian(_need(data, at + 1, size), signed)
    return np.full((data[at] & 7) + 3, _int64(value), np.int64), at + 1 + size


def _head(data: bytes, at: int) -> tuple[int, int]:
    """(width code, length) of the two-byte header."""
    head = _need(data, at, 2)
    return head[0] >> 1 & 31, ((head[0] & 1) << 8 | head[1]) + 1


def _direct(data: bytes, at: int, signed: bool) -> tuple[np.ndarray, int]:
    code, n = _head(data, at)
    size = _packed_size(WIDTHS[code], n)
    values = unpack(_need(data, at + 2, size), WIDTHS[code], n)
    return unzigzag(values) if signed else values.view(np.int64), at + 2 + size


def _delta(data: bytes, at: int, signed: bool) -> tuple[np.ndarray, int]:
    code, n = _head(data, at)
    width = WIDTHS[code] if code else 0
    base, at = decode_varint(data, at + 2)
    base = base >> 1 ^ -(base & 1) if signed else base
    first, at = decode_varint(data, at)
    first = first >> 1 ^ -(first & 1)
    steps = np.full(max(0, n - 1), _int64(first), np.int64)
    if width and n > 2:
        size = _packed_size(width, n - 2)
        rest = unpack(_need(data, at, size), width, n - 2).view(np.int64)
        steps[1:] = -rest if first < 0 else rest
        at += size
    with np.errstate(over="ignore"):
        return np.concatenate(([np.int64(_int64(base))], np.int64(_int64(base)) + np.cumsum(steps, dtype=np.int64))), at


def _patched(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Most numbers fit few bits above a base; a list of (gap, high bits) patches the others."""
    code, n = _head(data, at)
    third, fourth = _need(data, at + 2, 2)
    width, base_bytes = WIDTHS[code], (third >> 5) + 1
    patch_width, gap_width, patches = WIDTHS[third & 31], (fourth >> 5) + 1, fourth & 31
    at += 4
    raw = int.from_bytes(_need(data, at, base_bytes), "big")
    sign = 1 << (8 * base_bytes - 1)
    base = -(raw & ~sign) if raw & sign else raw
    at += base_bytes
    size = _packed_size(width, n)
    values = unpack(_need(data, at, size), width, n)
    at += size
    # entries of the patch list take the next width that the format has
    entry = next(w for w in WIDTHS if w >= patch_width + gap_width)
    size = _packed_size(entry, patches)
    where = 0
    for item in unpack(_need(data, at, size), entry, patches).tolist():
        where += item >> patch_width
        if where >= n:
            raise MalformedRleBlock("a patch lies beyond its run")
        values[where] |= np.uint64((item & (1 << patch_width) - 1) << width & _WRAP)
    with np.errstate(over="ignore"):
        return values.view(np.int64) + np.int64(base), at + size


def decode_integers(data: bytes, encoding: str, signed: bool, count: int | None = None) -> np.ndarray:
    """Numbers of a stream by its column's encoding."""
    return (decode_v2 if encoding.endswith("_V2") else decode_v1)(data, signed, count)


#: No run, and no number of a variable length that the format has, takes more bytes.
LONGEST = 8192


class Feed:
    """The bytes of a stream from its pieces, of which only what is not yet taken is held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.data, self.at = pieces, b"", 0

    def ahead(self, least: int = LONGEST) -> int:
        """Bytes at hand, at least so many unless the stream ends before."""
        held = [self.data[self.at :]] if len(self.data) - self.at < least else []
        size = sum(map(len, held))
        while held and size < least and (more := next(self.pieces, None)) is not None:
            held.append(more)
            size += len(more)
        if held:
            self.data, self.at = b"".join(held), 0
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        self.ahead(n)
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out

    def varints(self, n: int) -> list[np.ndarray]:
        """The next n variable-length numbers, fewer at the end, as arrays of 64-bit patterns, or of Python's where larger ones are among them."""
        out: list[np.ndarray] = []
        while n and self.ahead():
            b = np.frombuffer(self.data, np.uint8)[self.at : self.at + 20 * n]
            ends = np.flatnonzero(b < 128)[:n]
            if not len(ends):
                raise MalformedRleBlock("a variable-length number is cut short")
            b = b[: ends[-1] + 1]
            starts = np.concatenate(([0], ends[:-1] + 1))
            sizes = ends - starts + 1
            if sizes.max() <= 9:
                place = np.arange(len(b)) - np.repeat(starts, sizes)
                out.append(np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts))
            else:
                raw = b.tobytes()
                out.append(np.array([decode_varint(raw, int(at))[0] for at in starts], object))
            self.at += len(b)
            n -= len(ends)
        return out


class Runs:
    """The values of a stream's runs, in the numbers asked for."""

    def __init__(self, feed: Feed, run, kind):
        self.feed, self.run, self.rest = feed, run, np.zeros(0, kind)

    def take(self, n: int) -> np.ndarray:
        parts, have = [self.rest], len(self.rest)
        while have < n:
            if not self.feed.ahead():
                raise MalformedRleBlock(f"{n} values were expected, {have} are there")
            part, self.feed.at = self.run(self.feed.data, self.feed.at)
            parts.append(part)
            have += len(part)
        whole = np.concatenate(parts)
        self.rest = whole[n:].copy()
        return whole[:n]

    def lots(self, n: int) -> Iterator[np.ndarray]:
        """All values to the stream's end, about n at a time."""
        while self.feed.ahead():
            parts, have = [], 0
            while have < n and self.feed.ahead():
                part, self.feed.at = self.run(self.feed.data, self.feed.at)
                parts.append(part)
                have += len(part)
            yield np.concatenate(parts)


def integers(feed: Feed, encoding: str, signed: bool) -> Runs:
    """As decode_integers, in the numbers asked for."""
    run = _v2_run if encoding.endswith("_V2") else _v1_run
    return Runs(feed, lambda data, at: run(data, at, signed), np.int64)


def byte_values(feed: Feed) -> Runs:
    return Runs(feed, _bytes_run, np.uint8)


class Booleans:
    """The bits of byte runs, the highest of each byte first."""

    def __init__(self, feed: Feed):
        self.octets, self.rest = byte_values(feed), np.zeros(0, bool)

    def take(self, n: int) -> np.ndarray:
        more = np.unpackbits(self.octets.take((max(0, n - len(self.rest)) + 7) // 8)).astype(bool)
        whole = np.concatenate((self.rest, more))
        self.rest = whole[n:]
        return whole[:n]


def encode_v1(values, signed: bool) -> bytes:
    """Version 1: runs of a fixed step from three numbers on, literals between."""
    values = [int(v) for v in values]
    out, literal, at = bytearray(), [], 0

    def number(v: int) -> bytes:
        return encode_varint((v << 1) ^ (v >> 63) if signed else v)

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(256 - len(part))
            out.extend(b"".join(map(number, part)))
        literal.clear()

    while at < len(values):
        end = at + 1
        step = values[end] - values[at] if end < len(values) else 0
        if -128 <= step <= 127:
            while end < len(values) and values[end] - values[end - 1] == step and end - at < 130:
                end += 1
        if end - at >= 3:
            flush()
            out += bytes((end - at - 3, step & 255)) + number(values[at])
            at = end
        else:
            literal.append(values[at])
            at += 1
    flush()
    return bytes(out)
