"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, with all counts in sharded tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import Scratch, join_small, map_arrow, table

#: Characters (code points, none left out) of the longest n-grams.
ORDER = 4
#: Stands before a text's first character, as often as n-grams need.
EDGE = "\x02"
#: Characters and texts of a block, at about which it is closed; a text is never cut.
BLOCK, TEXTS = 5 << 20, 60_000
#: Codes up to so many are numbered by a table, more by sorting.
DENSE = 1 << 23


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The texts of a task in blocks."""
    lot, size = [], 0
    for batch in batches:
        for t in batch.column("text"):
            text = t.as_py() or ""
            if lot and (size + len(text) > BLOCK or len(lot) == TEXTS):
                yield lot
                lot, size = [], 0
            lot.append(text)
            size += len(text)
    if lot:
        yield lot


def _numbered(code: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Codes below `most` -> the same numbered without gaps, in their order, and how many there are."""
    if most > DENSE:
        names, code = np.unique(code, return_inverse=True)
        return code.astype(np.int32), len(names)
    here = np.zeros(most, bool)
    here[code] = True
    return (np.cumsum(here, dtype=np.int32) - 1)[code], int(here.sum())


def grams_of(texts: list[str], order: int = ORDER) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(n-grams that occur, each once; for each character of all texts in a row the place of the n-gram that ends at it; its text)."""
    points = np.frombuffer((EDGE * (order - 1)).join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    own = np.ones(len(points), bool)  # characters of texts, not edges
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])) + (order - 1) * np.arange(len(texts))
    own[(before[:, None] + np.arange(order - 1)[None, :]).ravel()] = False
    symbols, base = _numbered(points, 0x110000)
    place, many = symbols, base
    for _ in range(order - 1):  # an n-gram is the one that ends a place before, and a character
        longer = symbols.astype(np.int32 if many * base < 1 << 31 else np.int64)
        longer[1:] += place[:-1].astype(longer.dtype) * base
        place, many = _numbered(longer, many * base)
    place, many = _numbered(place[own], max(1, many))
    at = np.zeros(many, np.int64)
    at[place] = np.flatnonzero(own)
    flat = points[at[:, None] + np.arange(1 - order, 1)[None, :]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + order] for i in range(0, len(flat), order)], place, owner


def _count(order: int):
    def counts(lot: list[str]) -> pa.RecordBatch:
        grams, place, _ = grams_of(lot, order)
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.bincount(place, minlength=len(grams)), pa.int64())], ["gram", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(counts, _lots(batches))

    return run


def _name(text: Column) -> Column:
    """What tells a text from others: half of its MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _digest(texts: list[str]) -> np.ndarray:
    return np.array([int(hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()[:15], 16) for t in texts], np.int64)


def _blocks(order: int):
    """Texts -> a row for each block: its name (by what it holds), its texts by digest and length, its n-grams, and for each n-gram in turn
    the texts that have it and how often (255 at a time)."""

    def block(lot: list[str]) -> pa.RecordBatch:
        grams, place, owner = grams_of(lot, order)
        pair, counts = np.unique(place.astype(np.int64) * len(lot) + owner, return_counts=True)
        more = -(-counts // 255)
        pair = np.repeat(pair, more)
        times = np.full(len(pair), 255, np.uint8)
        times[np.cumsum(more) - 1] = counts - 255 * (more - 1)
        which, text = pair // len(lot), (pair % len(lot)).astype(np.int32)
        starts = np.searchsorted(which, np.arange(len(grams) + 1)).astype(np.int32)
        steps = np.diff(text, prepend=0)
        steps[starts[:-1]] = text[starts[:-1]]
        steps = steps.astype(np.uint16)
        digests = _digest(lot)
        name = int(np.uint64(xxhash.xxh3_64_intdigest(digests.tobytes())).view(np.int64))
        held = [digests, np.array([len(t) for t in lot], np.int64), np.diff(starts).astype(np.int32), (steps & 255).astype(np.uint8), (steps >> 8).astype(np.uint8), times]
        columns = [pa.array([name], pa.int64()), pa.array([grams], pa.list_(pa.string())), *[pa.array([_packed(x)], pa.binary()) for x in held]]
        return pa.RecordBatch.from_arrays(columns, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(block, _lots(batches))  # what a block takes is free before the next one

    return run


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


_BLOCK = ["block", "grams", "digests", "chars", "many", "steps", "far", "times"]


def _sums(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """A block and log p of its n-grams -> log p of its texts."""
    at, first = np.unique(found.column("at").to_numpy(), return_index=True)
    log_p = found.column("log_p").to_numpy()[first]
    out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    for row in blocks.to_pylist()[:1]:  # blocks of one name hold the same texts
        many, chars = _unpacked(row["many"], np.int32), _unpacked(row["chars"], np.int64)
        if len(at) != len(many):
            raise RuntimeError("a block has n-grams without probabilities: its texts came otherwise the second time")
        text = np.cumsum(_unpacked(row["steps"], np.uint8) + (_unpacked(row["far"], np.uint8).astype(np.int64) << 8))
        before = np.concatenate(([0], text))[np.cumsum(many) - many]  # each n-gram's texts are counted from 0
        text -= np.repeat(before, many)
        weights = np.repeat(log_p.astype(np.float64), many) * _unpacked(row["times"], np.uint8)
        out = [_unpacked(row["digests"], np.int64), chars, np.bincount(text, weights, minlength=len(chars)).astype(np.float64)]
    return pa.table([pa.array(x) for x in out], ["digest", "chars", "log_p"])


@dataclass
class KneserNey:
    """counts joined into tables: parts[n] (gram, part) and gammas[n] (context, gamma) of n-grams of n + 1 characters; `first` is the
    probability of any character before any n-gram is known."""

    parts: list[DataFrame]
    gammas: list[DataFrame]
    first: float
    scratch: Scratch

    @property
    def order(self) -> int:
        return len(self.parts)

    def log_p(self, grams: DataFrame) -> DataFrame:
        """(gram) of `order` characters, each once -> gram, log_p of its last character behind the others. The suffixes of all grams, each once,
        get their probability from the next shorter ones; keys repeat as often as characters can precede or follow."""
        levels = [grams]
        for n in range(self.order - 1, 0, -1):
            levels.append(self.scratch.keep(levels[-1].select(F.substring("gram", 2, n).alias("gram")).distinct(), f"suffixes-{n}"))
        p: DataFrame | None = None
        for n, level in enumerate(reversed(levels), 1):
            got = level.join(self.parts[n - 1], "gram", "left").withColumn("context", F.substring("gram", 1, n - 1))
            got = got.join(self.gammas[n - 1], "context", "left").withColumn("suffix", F.substring("gram", 2, n - 1))
            lower: Column = F.lit(self.first)
            if p is not None:
                got, lower = got.join(p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix", "left"), F.col("lower")
            p = self.scratch.keep(got.select("gram", (F.coalesce("part", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * lower).alias("p")), f"p-{n}")
        return p.select("gram", F.log("p").alias("log_p"))


def _level(counts: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(gram, part) and (context, gamma): what is left of each n-gram's share of its context after the discount, and what the
    discounts give to the lower order. Counts and contexts are joined by context, sharded by it."""
    n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.sum((F.col("c") == k).cast("long")) for k in range(1, 5)]).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [min(max(k - (k + 1) * y * (b / a if a else 0.0), 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    counts = counts.select("gram", "c", discount.alias("d"), F.substring("gram", 1, n - 1).alias("context"))
    contexts = scratch.keep(counts.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")), f"contexts-{n}")
    parts = counts.join(contexts, "context").select("gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("part"))
    return scratch.keep(parts, f"parts-{n}"), contexts.select("context", "gamma")


def train(trusted: DataFrame, scratch: Scratch, order: int = ORDER) -> KneserNey:
    """A model of the text column of all trusted rows. The highest order takes counts of n-grams, summed in each task first; each lower
    one the numbers of different characters before it."""
    counts = map_arrow(trusted.select("text"), _count(order), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    parts: list = [None] * order
    gammas: list = [None] * order
    for n in range(order, 0, -1):
        counts = scratch.keep(counts, f"counts-{n}")
        parts[n - 1], gammas[n - 1] = _level(counts, n, scratch)
        known = counts.count() if n == 1 else 0
        counts = counts.groupBy(F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("c"))
    return KneserNey(parts, gammas, 1.0 / (known + 1), scratch)


def text_scores(texts: DataFrame, model: KneserNey) -> DataFrame:
    """(text) -> digest, chars, log_p (sum over its characters) of each different text; null is empty.

    Tasks take their texts in blocks and send each n-gram of a block once to the shards of the model; its probability comes back to the
    block, which knows the texts that have it and how often. A frequent n-gram is one row for each block, and where
    they are joined, large partitions are split."""
    scratch = model.scratch
    ship_package(texts.sparkSession)
    blocks = map_arrow(texts.select("text"), _blocks(model.order), "block long, grams array<string>, digests binary, chars binary, many binary, steps binary, far binary, times binary")
    wanted = scratch.keep(blocks.select("block", F.posexplode("grams").alias("at", "gram")), "wanted")
    log_p = scratch.keep(model.log_p(scratch.keep(wanted.select("gram").distinct(), "grams")), "log_p")
    found = wanted.join(log_p, "gram").select("block", "at", F.col("log_p").cast("float").alias("log_p"))
    # the blocks are made a second time rather than stored; they find each other by what they hold
    summed = blocks.drop("grams").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_sums, "digest long, chars long, log_p double")
    out = scratch.keep(summed.groupBy("digest").agg(F.max("chars").alias("chars"), F.min("log_p").alias("log_p")), "scores")
    scratch.drop(wanted, log_p)
    return out


def quality(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.05, prior: int = 64, order: int = ORDER) -> DataFrame:
    """The rows of docs, all columns, with perplexity (per character), threshold and kept (which they replace).

    The model is trained on the documents labelled quality = 1 but for a fifth, by a hash of their ids, from which the thresholds
    come: a language's threshold is the quantile of the perplexities of its trusted documents that the model has not seen, times
    slack; a language without any takes that of all of them. A document is kept up to the threshold. So that short texts are not
    judged by chance, a text counts as if `prior` characters of the mean of those documents stood before it.

    Defined results: null and empty texts have the mean's perplexity and are kept; a null language is a language of its own; equal
    texts are scored alike, and rows with one doc_id each by their own text; texts of any length are taken whole; without trusted text, or
    none of it apart, all thresholds are null and all rows kept; label rows without id count for nothing; an empty table stays empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct()
    n = good.count()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    trusted = join_small(texts, good, F.col("doc_id") == F.col("__good"), "left_semi", n, 16)
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(trusted.where(~apart), scratch, order)
    scores = text_scores(texts, model)

    rest = [c for c in docs.columns if c not in ("perplexity", "threshold", "kept")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    named = docs.select(row, F.col("doc_id").alias("id"), F.col("lang").alias("lang"), _name(F.col("text").cast("string")).alias("digest"))
    scored = named.join(scores, "digest")
    own = join_small(scored.where((F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0)), good, F.col("id") == F.col("__good"), "left_semi", n, 16)
    own = scratch.keep(own.select("lang", "chars", "log_p"), "apart")
    chars, log_p = own.agg(F.sum("chars"), F.sum("log_p")).first()
    mean = log_p / chars if chars else float(np.log(model.first))
    perplexity = F.exp(-(F.col("log_p") + prior * mean) / (F.col("chars") + prior))
    limit = (F.percentile_approx(perplexity, quantile, 10000) * slack).alias("threshold")
    limits = scratch.keep(own.groupBy(F.col("lang").alias("__lang")).agg(limit), "limits")
    general = own.agg(limit).first()[0] if chars else None
    out = scored.withColumn("perplexity", perplexity)
    out = join_small(out, limits, F.col("lang").eqNullSafe(F.col("__lang")), "left", limits.count(), 64)
    threshold = F.coalesce("threshold", F.lit(general).cast("double"))
    kept = F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select(*[F.col(f"row.`{c}`") for c in rest], "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents and whether they are kept."""
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "perplexity", "threshold", "kept")
