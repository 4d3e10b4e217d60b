"""Substring deduplication over sliding spans of sentences and, if asked, runs of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, map_arrow, table
from .shingles import chunks, mix64, word_hashes

#: Sentences of a span.
SPAN = 3
#: A sentence ends behind stops with white space after them, behind full-width stops, or behind line breaks.
END = re.compile(r"[.!?]+[ \t\n\r\f\v]+|[。！？｡]+[ \t\n\r\f\v]*|\n[ \t\n\r\f\v]*")
BLANK = " \t\n\r\f\v"
_WORD = re.compile(WORD.encode())
#: Bases of the two 64-bit hashes of a run of words.
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sentences(text: str) -> list[str]:
    """The sentences of a text with the white space behind them; joined, they are the text."""
    ends = [m.end() for m in END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]


def span_hashes(pieces: list[str], span: int) -> list[bytes]:
    """A 128-bit hash of every run of `span` consecutive sentences, without the white space around each sentence."""
    bare = [p.strip(BLANK).encode("utf-8", "surrogatepass") for p in pieces]
    return [xxhash.xxh3_128_digest(b"\n".join(bare[i : i + span])) for i in range(len(bare) - span + 1)]


def _spans(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = set(span_hashes(sentences(text.as_py() or ""), span))
                hashes.extend(found)
                ids.extend([doc_id] * len(found))
                if len(ids) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], ["h", "doc_id"])
                    ids, hashes = [], []
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64())], ["h", "doc_id"])

    return run


def covered(spans: list[bytes], gone: set[bytes], n: int, span: int) -> np.ndarray:
    """Which of n sentences lie in a span whose first 8 bytes are in `gone`, or that comes a second time in this text."""
    out, seen = np.zeros(n, bool), set()
    for i, h in enumerate(spans):
        if h[:8] in gone or h in seen:
            out[i : i + span] = True
        seen.add(h)
    return out

def run_hashes(words: np.ndarray, n: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of every run of n consecutive words, from the words' hashes."""
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        rolled = rolled * base + words[j : j + len(rolled)]
    return mix64(rolled)


def anchors(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of half as many words, the least in every run of n words: runs of n words that are equal have an anchor in common."""
    small = run_hashes(words, n // 2)
    width = n - n // 2 + 1
    if len(small) < width:
        return small[:0]
    return small[np.unique(np.lib.stride_tricks.sliding_window_view(small, width).argmin(axis=1) + np.arange(len(small) - width + 1))]


def again(runs: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words come a second time, behind the end of the first."""
    _, first, of = np.unique(runs, return_index=True, return_inverse=True)
    return np.arange(len(runs)) - first[of] >= n


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Batches of (doc_id, text, ...) -> batch, row and word hashes of each text."""
    for batch in batches:
        for first, raw, offsets in chunks(batch.column("text")):
            words, at = word_hashes(raw, offsets, lower=False)
            for i in range(len(offsets) - 1):
                yield batch, first + i, words[at[i] : at[i + 1]]


def _hashes(rows: Iterator[tuple[int, bool, tuple[np.ndarray, ...]]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, twice, columns of hashes) -> batches of many rows."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        n = [len(columns[0]) for _, _, columns in held]
        hashes = [pa.array(np.concatenate(c).view(np.int64)) for c in zip(*[columns for _, _, columns in held], strict=True)]
        return pa.RecordBatch.from_arrays([*hashes, pa.array(np.repeat([d for d, _, _ in held], n), pa.int64()), pa.array(np.repeat([t for _, t, _ in held], n), pa.bool_())], names)

    for row in rows:
        if len(row[2][0]):
            held.append(row)
            size += len(row[2][0])
        if size > 100_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _anchors(n: int):
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch, i, words in _texts(batches):
            found = anchors(words, n)
            different, count = np.unique(found, return_counts=True)
            doc_id = batch.column("doc_id")[i].as_py()
            yield doc_id, False, (different[count == 1],)
            yield doc_id, True, (different[count > 1],)

    return lambda batches: _hashes(rows(batches), ["h", "doc_id", "twice"])


def _runs(n: int):
    """(doc_id, text, anchors) -> the different runs of n words that hold one of the anchors; twice: again within the text."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch, i, words in _texts(batches):
            hit = np.isin(run_hashes(words, n // 2), np.array(batch.column("anchors")[i].as_py(), np.int64).view(np.uint64))
            one, two = (run_hashes(words, n, base) for base in _BASES)
            sums = np.concatenate(([0], np.cumsum(hit)))
            near = np.flatnonzero(sums[n - n // 2 + 1 :][: len(one)] > sums[: len(one)])
            twice = np.isin(one, one[again(one, n)])[near]
            _, first = np.unique(one[near], return_index=True)
            doc_id, near, twice = batch.column("doc_id")[i].as_py(), near[first], twice[first]
            yield doc_id, False, (one[near[~twice]], two[near[~twice]])
            yield doc_id, True, (one[near[twice]], two[near[twice]])

    return lambda batches: _hashes(rows(batches), ["h", "h2", "doc_id", "twice"])


def _repeated_runs(texts: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(doc_id, runs) of the documents that hold repeats of n words: the hashes of runs that a smaller doc_id has."""
    first, last, twice = F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("twice").alias("any")
    marks = scratch.keep(map_arrow(texts, _anchors(n), "h long, doc_id long, twice boolean"), "anchors")
    shared = scratch.keep(marks.groupBy("h").agg(first, last, twice).where("first < last or any").select("h"), "shared")
    hits = scratch.keep(marks.join(shared, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("h").alias("anchors")), "hits")
    runs = scratch.keep(map_arrow(texts.join(hits, "doc_id"), _runs(n), "h long, h2 long, doc_id long, twice boolean"), "runs")
    repeated = runs.groupBy("h", "h2").agg(first, last, twice).where("first < last or any").select("h", "h2", "first")
    repeated = scratch.keep(repeated, "repeated")
    later = runs.join(repeated, ["h", "h2"]).where("doc_id > first or twice")
    gone = scratch.keep(later.groupBy("doc_id").agg(F.collect_set(F.when(F.col("doc_id") > F.col("first"), F.col("h"))).alias("runs")), "gone_runs")
    scratch.drop(marks, shared, hits, runs, repeated)
    return gone


def covered_bytes(raw: bytes, gone: list[int], n: int) -> np.ndarray:
    """Which bytes lie in a run of n words whose hash is in `gone`, or that comes a second time in this text, with the white space behind."""
    out = np.zeros(len(raw), bool)
    words, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)
    runs = run_hashes(words, n)
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    for i in np.flatnonzero(np.isin(runs, np.array(gone, np.int64).view(np.uint64)) | again(runs, n)).tolist():
        out[starts[i] : starts[i + n]] = True
    return out


def _cut(span: int, n: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, column, runs = batch.column("__gone"), batch.column("__text"), batch.column("__runs")
            texts, counts, drops = [], [], []
            for text, g, r in zip(column, gone, runs, strict=True):
                text, r = text.as_py(), r.as_py()
                pieces = sentences(text or "")
                counts.append(len(pieces))
                spans = span_hashes(pieces, span)
                bad = set(g.as_py() or ())
                if r is None and not bad and len(set(spans)) == len(spans):
                    texts.append(text)
                    drops.append(0)
                    continue
                drop = covered(spans, bad, len(pieces), span)
                if r is not None and text:
                    raw, ends = text.encode("utf-8", "surrogatepass"), np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in pieces])
                    away = covered_bytes(raw, r, n) | np.repeat(drop, np.diff(ends, prepend=0))
                    texts.append(np.frombuffer(raw, np.uint8)[~away].tobytes().decode("utf-8", "surrogatepass"))
                    drops.append(int(np.logical_and.reduceat(away, ends - np.diff(ends, prepend=0)).sum()))
                    continue
                texts.append("".join(p for p, d in zip(pieces, drop.tolist(), strict=True) if not d))
                drops.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(drops, pa.int64())],
                ["row", "text", "n_sentences", "n_removed"],
            )

    return run


def remove_repeated_spans(docs: DataFrame, span: int = SPAN, words: int | None = None) -> DataFrame:
    """The rows of docs, all columns, with repeated passages cut from text; adds (or replaces) n_sentences and n_removed.

    Every run of `span` consecutive sentences is hashed and joined over all documents. The first place of a run is in the document with the
    smallest doc_id, at its first position there; every sentence that any other place covers goes, however short it is.

    With `words`, runs of so many words (at least 2; as in common.WORD) that come again are found too, wherever they begin and end in sentences: in every place but
    the first their words go, with the white space behind them; within one document, places that overlap the first stay. Only runs that share an
    anchor (the least hash of half as many words in a row) with another place are hashed and joined, and equal runs always share one. n_removed counts sentences of
    which nothing stays.

    Defined results: null text stays null, a text of fewer than `span` sentences, or an empty one, stays as it is; rows with one doc_id
    count as one document and share its first places; a row without doc_id loses only what it repeats itself; a document all of
    whose sentences are repeats keeps its row with an empty text; texts of any length are taken whole; an empty table stays empty. A hot
    passage is one row for each document that has it; its rows are counted in their tasks first, and where they are joined, large
    partitions are split.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spans")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = scratch.keep(map_arrow(texts, _spans(span), "h binary, doc_id long"), "spans")
    repeated = spans.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    repeated = scratch.keep(repeated, "repeated")  # so that the join is of two plain tables, whose hot partitions Spark splits
    later = spans.join(repeated, "h").where("doc_id > first")
    gone = scratch.keep(later.groupBy("doc_id").agg(F.collect_list(F.substring("h", 1, 8)).alias("gone")), "gone")
    scratch.drop(spans, repeated)
    if words:
        gone = gone.join(_repeated_runs(texts, words, scratch), "doc_id", "full")
    else:
        gone = gone.withColumn("runs", F.lit(None).cast("array<long>"))
    rest = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    named = docs.select(row, F.col("text").cast("string").alias("__text"), F.col("doc_id").cast("long").alias("__id"))
    alone = F.col("__id").isNull() & F.col("__text").isNotNull() & F.lit(bool(words))  # its own repeats are sought where it is cut
    runs = F.when(alone, F.array().cast("array<long>")).otherwise(F.col("__runs")).alias("__runs")
    # texts go by doc_id at every size: what is removed grows with the corpus
    out = named.join(gone.select(F.col("doc_id").alias("__gone_id"), F.col("gone").alias("__gone"), F.col("runs").alias("__runs")), F.col("__id") == F.col("__gone_id"), "left")
    fields = [T.StructField("row", named.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]
    cut = map_arrow(out.select("row", "__text", "__gone", runs), _cut(span, words), T.StructType(fields))
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_sentences", "n_removed")]
    return cut.select(*kept, "n_sentences", "n_removed")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts repeated passages from all documents."""
    return remove_repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


OP10_SQL = r"""
WITH p AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?]+[ \t\n\r\f\v]+|[。！？｡]+[ \t\n\r\f\v]*|\n[ \t\n\r\f\v]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s
  FROM documents),
i AS (SELECT doc_id, unnest(s) AS piece, unnest(range(len(s))) AS pos FROM p),
n AS (SELECT *, trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM i),
r AS (SELECT *, lead(bare, 1) OVER w AS second, lead(bare, 2) OVER w AS third FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY bare || chr(10) || second || chr(10) || third ORDER BY doc_id, pos) > 1 AS again FROM r WHERE third IS NOT NULL),
a AS (SELECT r.doc_id, r.pos, r.piece, coalesce(f.again, false) AS again FROM r LEFT JOIN f ON r.doc_id = f.doc_id AND r.pos = f.pos),
c AS (SELECT doc_id, pos, piece, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM a)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(string_agg(c.piece, '' ORDER BY c.pos) FILTER (NOT c.gone), '') END AS text,
       count(c.pos)::BIGINT AS n_sentences, (count(c.pos) FILTER (c.gone))::BIGINT AS n_removed
FROM p LEFT JOIN c ON p.doc_id = c.doc_id GROUP BY p.doc_id, p.text
"""
