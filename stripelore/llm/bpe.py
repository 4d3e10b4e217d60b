"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_HAND, map_arrow, table
from .shingles import mix64


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id; ids are 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(b): base64.b64decode(a) for a, b in pairs}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: n keys, n slots, one displacement per bucket of four keys.

    A key's bucket says how far its slot is displaced; buckets of one key say their slot itself (as -1 - slot)."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.m = max(1, n // 4)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) < n:
            raise ValueError("two keys have one 64-bit hash, or a key comes twice")
        self.moves = np.zeros(self.m, np.int64)
        bucket = (h % np.uint64(self.m)).astype(np.int64)
        a, b = self._parts(h)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.m + 1))
        sizes = np.diff(ends)
        free = np.ones(n, bool)
        slot_of = np.empty(n, np.int64)
        for q in np.argsort(-sizes, kind="stable"):
            own = order[ends[q] : ends[q + 1]]
            if len(own) < 2:
                break
            d = 0
            while True:
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = ((a[own][:, None] + tries[None, :] * b[own][:, None]) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(0) & (np.diff(np.sort(slots, 0), axis=0) > 0).all(0)
                if good.any():
                    k = int(good.argmax())
                    self.moves[q] = d + k
                    free[slots[:, k]] = False
                    slot_of[own] = slots[:, k]
                    break
                d += 64
        single = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)
        self.moves[single] = -1 - left
        slot_of[order[ends[single]]] = left
        self.key = np.empty(n, np.int64)  # slot -> id
        self.key[slot_of] = np.arange(n)

    @staticmethod
    def _parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return a >> np.uint64(20), (mix64(a) >> np.uint64(44)) | np.uint64(1)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """The one id that each key can have; whether it has it, its bytes must tell."""
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        d = self.moves[(h % np.uint64(self.m)).astype(np.int64)]
        a, b = self._parts(h)
        moved = ((a + np.maximum(d, 0).astype(np.uint64) * b) % np.uint64(self.n)).astype(np.int64)
        return self.key[np.where(d < 0, -1 - d, moved)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by merging its lowest-ranked neighbours, the leftmost first. Parts are linked by their ends;
    the heap holds pairs, and those whose parts have changed since are skipped. O(n log n)."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # part at i covers piece[i:end[i]]; 0 once it is merged into the one before
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to or mid == to:
            continue
        end[i], end[mid] = to, 0
        if to < n:
            before[to] = i
            r = ranks.get(piece[i : end[to]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[to]))
        p = before[i]
        if p >= 0:
            r = ranks.get(piece[p:to])
            if r is not None:
                heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Tokenizer:
    """Encodes texts and decodes ids. `remembered` bounds the number of pre-tokens whose ids are kept at hand, in two generations: what
    has not come up since the younger one began goes when that is full."""

    def __init__(self, tokens: list[bytes], pattern: str, hashed: PerfectHash, remembered: int = 600_000):
        self.tokens, self.hashed, self.remembered = tokens, hashed, remembered
        self.ranks = {t: i for i, t in enumerate(tokens)}
        # \s in the pattern means the property White_Space; other libraries' \s also takes U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Finds the ids of pre-tokens: the perfect hash for those in the vocabulary, the heap for the others."""
        raw = [p.encode("utf-8") for p in pieces]
        for piece, b, i in zip(pieces, raw, self.hashed.candidates(raw).tolist(), strict=True):
            ids = (i,) if self.tokens[i] == b else merge(b, self.ranks)
            self.known[piece] = b"".join([x.to_bytes(4, "little") for x in ids])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.split(text)
        new = set(pieces).difference(self.known)
        if new:
            if len(self.known) > self.remembered // 2:
                self.older, self.known = self.known, {}
                new = set(pieces)
            again = {p: self.older[p] for p in new if p in self.older}
            self.known.update(again)
            new.difference_update(again)
            if new:
                self.learn(list(new))
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


#: One tokenizer for each vocabulary and worker process; a task finds it as the one before left it.
_AT_HAND: dict[tuple, Tokenizer] = {}
AT_HAND["bpe"] = _AT_HAND


def _tokenizer(shared) -> Tokenizer:
    key, tokens, pattern, hashed = shared.value
    if key not in _AT_HAND:
        _AT_HAND.clear()
        _AT_HAND[key] = Tokenizer(tokens, pattern, hashed)
    return _AT_HAND[key]


def _share(spark: SparkSession, path: str | None, pattern: str | None):
    """Broadcast of the vocabulary and its perfect hash: a fixed file, some 50,000 tokens."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast(((path, pattern), tokens, pattern or public_tokenizers.PATTERN, PerfectHash(tokens)))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, column: str = "text", out: str = "ids") -> DataFrame:
    """Adds (or replaces) a column of token ids, array<int>, of each whole text by the ranks in `path`, each match of
    `pattern` by itself and without special tokens. Null and empty texts have no ids. Rows are not moved, so
    ties, repeated rows and hot sources make no difference; an empty table stays empty."""
    shared = _share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared)
        for batch in batches:
            texts, step = batch.column("text"), 256
            for first in range(0, len(texts), step):
                ids = [tokenizer.encode(t.as_py() or "") for t in texts.slice(first, step)]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, step), pa.ListArray.from_arrays(offsets, values)], ["row", "ids"])

    return _around(docs, column, "text", F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")), run, out, "ids", T.ArrayType(T.IntegerType()))


def decode(docs: DataFrame, path: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds (or replaces) a binary column with the bytes that the ids in `column` stand for; null has no bytes."""
    shared = _share(docs.sparkSession, path, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared)
        for batch in batches:
            lists, step = batch.column("ids"), 256
            for first in range(0, len(lists), step):
                raw = [b"" if x.values is None else tokenizer.decode(x.values.to_numpy(zero_copy_only=False)) for x in lists.slice(first, step)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, step), pa.array(raw, pa.binary())], ["row", "decoded"])

    return _around(docs, column, "ids", F.col(f"`{column}`"), run, out, "decoded", T.BinaryType())


def _around(docs: DataFrame, column: str, name: str, value, run, out: str, got: str, kind: T.DataType) -> DataFrame:
    """Runs a function of Arrow batches on one column; the other columns travel in a struct, so names cannot clash."""
    rest = [c for c in docs.columns if c != out]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([T.StructField("row", docs.select(row.alias("row")).schema["row"].dataType), T.StructField(got, kind)])
    made = map_arrow(docs.select(row.alias("row"), value.alias(name)), run, schema, "bpe")
    return made.select(*[F.col(f"row.`{c}`") for c in rest], F.col(got).alias(out))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids_bytes (ids as little-endian unsigned 32-bit integers) and decoded (the bytes these ids stand for) of
    the whole texts of docs, encoded and decoded in one pass. Null texts are empty; one row for each row."""
    shared = _share(docs.sparkSession, path, pattern)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared)
        for batch in batches:
            texts, step = batch.column("text"), 256
            for first in range(0, len(texts), step):
                ids = [tokenizer.encode(t.as_py() or "") for t in texts.slice(first, step)]
                back = [tokenizer.decode(np.frombuffer(x, "<u4")) for x in ids]
                columns = [batch.column("doc_id").slice(first, step), pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids_bytes", "decoded"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids_bytes", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, schema, "bpe")


def encode_and_decode(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text."""
    return round_trip(docs).select(
        "doc_id",
        (F.octet_length("ids_bytes") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents."""
    return encode_and_decode(table(spark, sf_dir, "documents"))
