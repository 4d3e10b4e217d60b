"""MinHash near-duplicates: bands find candidates, odd sketches verify them, full sets confirm the links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import Scratch, join_small, map_arrow, table
from .components import components
from .shingles import chunks, mix64, shingle_hashes, word_hashes

#: 25 bands of 5 samples: a pair at similarity 0.8 shares no band once in 20,000 times, one at 0.85 once in 2 million.
BANDS, ROWS = 25, 5
#: MinHash samples that an odd sketch folds (the bands take the first of them) and its bits, a multiple of 64.
SAMPLES, SKETCH = 1024, 4096
#: A candidate goes on to the full sets if its sketches put it at the threshold less this, more than four standard errors.
SLACK = 0.055
#: Sets of up to so many shingles on average are compared without regard to their sketches, which tell little of so few.
TINY = 64
#: Sets whose samples are held at a time.
LOT = 256
#: Buckets of up to so many sets are compared by a join, larger ones in blocks of so many sets with so many shingles in all.
SMALL, BLOCK, WEIGHT = 32, 1024, 2 << 20


def _family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return seeds[:samples], seeds[samples:] | np.uint32(1)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parity bitmap of each row of MinHash samples (texts x samples) as 64-bit words: sample (i, value) flips one bit."""
    n, k = samples.shape
    where = mix64(samples.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    at = where.astype(np.int64) + np.arange(n)[:, None] * bits
    flips = (np.bincount(at.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(flips.reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def most_differing(similarity: float, samples: int = SAMPLES, bits: int = SKETCH) -> int:
    """The largest XOR population count whose estimate 1 + bits / (4 samples) ln(1 - 2 count / bits) is `similarity` or more."""
    return int(bits / 2 * (1 - np.exp(-4 * samples / bits * (1 - similarity))))


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for first, raw, offsets in chunks(batch.column("text")):
            words, at = word_hashes(raw, offsets)
            yield batch.slice(first, len(offsets) - 1), shingle_hashes(words, at, k)


def _features(k: int, bands: int, rows: int):
    """Arrow batches of (doc_id, text) -> doc_id, n_shingles, sig (16 bytes that name the set), bands, sketch."""
    if bands * rows > SAMPLES:
        raise ValueError(f"bands * rows is more than the {SAMPLES} samples")
    xor, times = _family(SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches, k):
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            keys: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            for lot in np.split(full, range(LOT, len(full), LOT)):
                if not len(lot):
                    continue
                starts = np.concatenate(([0], np.cumsum(sizes[lot])[:-1]))
                low = (np.concatenate([sets[i] for i in lot]) >> np.uint64(32)).astype(np.uint32)
                least = np.empty((len(lot), SAMPLES), np.uint32)
                for j in range(SAMPLES):
                    least[:, j] = np.minimum.reduceat((low ^ xor[j]) * times[j], starts)
                key = np.zeros((len(lot), bands), np.uint64)
                for j in range(rows):
                    key = mix64(key * np.uint64(31) + least[:, j : bands * rows : rows].astype(np.uint64) + np.uint64(1))
                key = mix64(key + np.arange(bands, dtype=np.uint64)).view(np.int64)
                odd = odd_sketch(least)
                for n, i in enumerate(lot):
                    keys[i], sketches[i] = key[n], odd[n]
            sig = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "sig", "bands", "sketch"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches, k):
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"]
            )

    return run


def _apart(bits: int) -> Column:
    """XOR population count of the columns sketch_a and sketch_b."""
    words = [F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(bits // 64)]
    return reduce(lambda x, y: x + y, words)


def _confirm(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches agree enough and whose full sets have the similarity."""
    sketch = heads.select("node", "n", "sketch")
    near = pairs.join(sketch.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
    near = near.join(sketch.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
    near = near.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * F.lit(percent))
    alike = _apart(SKETCH) <= most_differing(percent / 100 - SLACK)
    near = near.where((F.col("n_a") + F.col("n_b") <= 2 * TINY) | alike).select("a", "b").distinct()
    near = scratch.keep(near, "near")
    nodes = scratch.keep(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    if not nodes.count():
        return near
    sets = _sets_of(nodes, docs, k, scratch)
    both = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t")).cast("long")
    both = both.select("a", "b", shared.alias("shared"), (F.size("s") + F.size("t")).cast("long").alias("total"))
    links = scratch.keep(both.where(F.col("shared") * 100 >= F.lit(percent) * (F.col("total") - F.col("shared"))).select("a", "b").distinct(), "links")
    scratch.drop(sets, near, nodes)
    return links


def _sets_of(nodes: DataFrame, docs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(node, shingles) of nodes."""
    texts = join_small(docs.select("doc_id", "text"), nodes, F.col("doc_id") == F.col("node"), "inner", nodes.count(), 16)
    return scratch.keep(map_arrow(texts.select("node", "text"), _sets(k), "node long, shingles array<long>"), "sets")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1)


class _Union:
    """Union-find over the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))])


def forest(sets: list[np.ndarray], component: np.ndarray, candidates: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets, of candidates (i, j, ascending in i), that join what `component` and the links before leave
    apart: together they connect all that the links among the candidates connect, with fewer links than there are sets."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    here, union, found = np.zeros(len(values), bool), _Union(len(sets)), []
    _, first, of = np.unique(component, return_index=True, return_inverse=True)
    union.up = first[of].tolist()
    cuts = np.flatnonzero(np.concatenate(([True], candidates[1:, 0] != candidates[:-1, 0]))).tolist() if len(candidates) else []
    for a, b in zip(cuts, [*cuts[1:], len(candidates)], strict=True):
        i, partners = int(candidates[a, 0]), candidates[a:b, 1]
        roots = union.roots()
        partners = partners[roots[partners] != roots[i]]
        # a few partners at a time, so that those that a link has joined meanwhile are left out
        for c in range(0, len(partners), 64):
            js = [j for j in partners[c : c + 64].tolist() if union.root(j) != union.root(i)]
            if not js:
                continue
            mine = place[starts[i] : starts[i + 1]]
            here[mine] = True
            flat = here[np.concatenate([place[starts[j] : starts[j + 1]] for j in js])]
            shared = np.add.reduceat(flat, np.concatenate(([0], np.cumsum(sizes[js])[:-1])), dtype=np.int64)
            here[mine] = False
            for j, n in zip(js, shared.tolist(), strict=True):
                if n * 100 >= percent * (sizes[i] + sizes[j] - n) and (x := union.root(i)) != (y := union.root(j)):
                    union.up[y] = x
                    found.append((i, j))
    return found


def _cells(most: int, percent: int):
    """Links between the members of two blocks of a large bucket, confirmed on the full sets; no more than the members need to be
    connected. A pair is compared in the first of the bands that it shares."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = {c: rows.column(c).chunk(0) for c in rows.column_names}
        bucket, side = key[0].as_py(), column["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        left = int((side == 0).sum())
        node, component, n = (column[c].to_numpy()[order] for c in ("node", "component", "n"))
        sketch, bands = _matrix(column["sketch"]).view(np.uint64)[order], _matrix(column["bands"])[order]
        flat, cuts = column["shingles"].flatten().to_numpy(), column["shingles"].offsets.to_numpy()
        cuts = cuts - cuts[0]
        sets = [flat[cuts[r] : cuts[r + 1]] for r in order.tolist()]
        first = 0 if key[2].as_py() == -1 else left  # here the outside block also meets itself
        x, y = sketch[:left], sketch[first:]
        apart = np.zeros((len(x), len(y)), np.uint16)
        for w in range(x.shape[1]):
            apart += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
        p, q = n[:left, None], n[None, first:]
        near = (apart <= most) | (p + q <= 2 * TINY)
        near &= np.minimum(p, q) * 100 >= np.maximum(p, q) * percent
        near &= component[:left, None] != component[None, first:]
        i, j = np.nonzero(near)
        j += first
        i, j = i[i < j], j[i < j]
        same = bands[i] == bands[j]
        here = bands[i, same.argmax(axis=1)] == bucket
        links = forest(sets, component, np.stack((i[here], j[here]), axis=1), percent) if here.any() else []
        a, b = node[[i for i, _ in links]], node[[j for _, j in links]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _within(many: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links that connect what links connect within large buckets. In a bucket, the members outside its main component are
    compared with all others: they meet each block of the main component and each other's blocks, while the main
    component's members, of whom most have nothing to be compared with but these, are not compared with each other."""
    ship_package(docs.sparkSession)
    sizes = many.groupBy("key", "component").agg(F.count("*").alias("own"), F.sum("n").alias("weight"))
    cut = sizes.groupBy("key").agg(F.max(F.struct("own", "component", "weight")).alias("main"), F.sum("own").alias("own"), F.sum("weight").alias("weight"))

    def blocks(members: Column, weight: Column) -> Column:
        return F.ceil(F.greatest(members / BLOCK, weight / WEIGHT)).cast("int")

    n_out, n_main = blocks(F.col("own") - F.col("main.own"), F.col("weight") - F.col("main.weight")), blocks(F.col("main.own"), F.col("main.weight"))
    cut = cut.select("key", F.col("main.component").alias("main"), n_out.alias("n_out"), n_main.alias("n_main"))
    many = scratch.keep(many.join(cut, "key").withColumn("out", F.col("component") != F.col("main")), "cut")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("n_out")).otherwise(F.col("n_main"))).cast("int")
    # cell (i, j): outside block i with outside block j, or, where j is negative, with block -1 - j of the main component; with -1, also with itself
    others = F.sequence(F.lit(0), F.col("n_out") - 1)
    outside = F.concat(
        F.transform(F.filter(others, lambda o: o != F.col("own")), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side"))),
        F.transform(F.sequence(F.lit(0), F.col("n_main") - 1), lambda x: F.struct(F.col("own").alias("i"), (-1 - x).alias("j"), F.lit(0).alias("side"))),
    )
    inside = F.transform(others, lambda o: F.struct(o.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side")))
    cells = many.withColumn("own", own).select("key", "node", "component", F.explode(F.when(F.col("out"), outside).otherwise(inside)).alias("cell"))
    sets = _sets_of(scratch.keep(many.select("node").distinct(), "nodes"), docs, k, scratch)
    facts = scratch.keep(heads.select("node", "n", "sketch", "bands").join(sets, "node"), "facts")
    cells = cells.select("key", "node", "component", "cell.*").join(facts, "node")
    links = cells.groupBy("key", "i", "j").applyInArrow(_cells(most_differing(percent / 100 - SLACK), percent), "a long, b long")
    links = scratch.keep(links.distinct(), "links")
    scratch.drop(sets, facts, many)
    return links


def _apart_in_buckets(shared: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, n, m, component) of the buckets of three or more whose members are in more than one component. Components only
    merge, so what an earlier call has returned serves as `shared` of a later one."""
    own = shared.where("m > 2").select("key", "node", "n", "m").join(found, "node", "left").select("key", "node", "n", "m", F.coalesce("component", "node").alias("component"))
    own = scratch.keep(own, "members")
    open_ = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    out = scratch.keep(own.join(open_, "key", "left_semi"), "open")
    scratch.drop(own)
    return out


def _sampled(many: DataFrame, scratch: Scratch, per_bucket: int = 4) -> tuple[int, DataFrame] | None:
    """How many members of large buckets stand outside the component of a random member, and their pairs with a few random members
    of that component. Most of a large group finds its component by these few, before pairs are sought in earnest."""
    if many.isEmpty():
        return None
    scratch.n += 1
    at_random = [F.xxhash64(F.col("node"), F.col("key"), F.lit(scratch.n * per_bucket + i)) for i in range(per_bucket)]
    main = many.groupBy("key").agg(F.min_by("component", at_random[0]).alias("main"))
    many = scratch.keep(many.join(main, "key"), "main")
    few = many.where("component = main").groupBy("key").agg(F.array_distinct(F.array(*[F.min_by("node", r) for r in at_random])).alias("few"))
    pairs = many.where("component <> main").join(few, "key").select(F.col("node").alias("x"), F.explode("few").alias("y"))
    pairs = scratch.keep(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "tried")
    return many.where("component <> main").select("node").distinct().count(), pairs


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row for each row of docs.

    A text's set holds its distinct k-word shingles (A-Z lower-cased); with fewer words, the whole sequence. Documents
    are linked if 100 * intersection >= percent * union, checked on the full sets; component_id is the smallest doc_id
    that links reach. Equal sets are one node from the start, so copies never meet in pairs. Each bucket of a band
    compares its members with its smallest one, large buckets then also what stands outside a component with a few of its
    members, as long as that merges components; what is still in more than one component is compared across the
    components, by a join in small buckets and in pairs of blocks in large ones. A pair of blocks confirms its links by itself, on
    the full sets, and returns no more of them than its members need to be connected. So every pair that shares a band is either in
    one component already or compared; to share none, or sketches more than SLACK off, are the only chances to miss a link.

    Defined results: null, empty and blank texts have no shingles, are linked with nothing and kept; a row without doc_id takes part in
    nothing, has a null component_id and is kept; rows with one doc_id are one document, whose sets are all compared. Texts of any
    length are taken whole, one at a time if they are long. Columns but doc_id and text play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = scratch.keep(
        map_arrow(docs, _features(k, bands, rows), "doc_id long, n_shingles long, sig binary, bands array<long>, sketch array<long>"), "features"
    )
    real = features.where("doc_id is not null and n_shingles > 0")
    # equal sets are one node: each task sends on one row of them at most
    heads = real.groupBy("sig").agg(F.min_by(F.struct(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "sketch"), "doc_id").alias("x"))
    heads = scratch.keep(heads.select("sig", "x.*"), "heads")
    members = heads.select("node", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("m")).where("pivot < last")
    shared = scratch.keep(members.join(buckets.select("key", "pivot", "m"), "key"), "buckets")
    links = _confirm(shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), heads, docs, k, percent, scratch)
    found = components(links, scratch)

    # what is still apart within a bucket of three or more
    own = _apart_in_buckets(shared, found, scratch)
    while tried := _sampled(own.where(F.col("m") > SMALL), scratch):
        outside, pairs = tried
        new = _confirm(pairs, heads, docs, k, percent, scratch)
        merged = new.count()
        if merged:
            links = links.unionByName(new)
            found = components(links, scratch)
            own = _apart_in_buckets(own, found, scratch)
        if merged * 20 < outside:
            break
    few = own.where(F.col("m") <= SMALL)
    other = few.select("key", F.col("node").alias("b"), F.col("component").alias("c"))
    pairs = few.join(other, "key").where("node < b and component <> c").select(F.col("node").alias("a"), "b")
    more = _confirm(pairs.distinct(), heads, docs, k, percent, scratch)
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links, scratch)
        own = _apart_in_buckets(own, found, scratch)
    many = own.where(F.col("m") > SMALL)
    if not many.isEmpty():
        more = _within(many, heads, docs, k, percent, scratch)
        if not more.isEmpty():
            found = components(links.unionByName(more), scratch)

    named = heads.select("sig", "node").join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    out = features.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("sig")).alias("sig"))
    out = out.join(named, "sig", "left")
    component = F.coalesce("component", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates keeps; of rows with one doc_id, the one whose text has the least hash, of
    rows without doc_id all."""
    result = near_duplicates(docs, k, percent)
    kept = result.where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), F.col("text").isNull(), F.to_json(F.struct(*names)))
    stay = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    stay = stay.groupBy("doc_id").agg(F.count("*").alias("__n"), F.min_by(F.struct(*names), order).alias("__row"))
    return stay.select(*[F.col(f"__row.`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents, on 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
