"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .cells import answers, op5_nearest_neighbours  # noqa: F401
from .cells import floats as _floats
from .common import Scratch, map_arrow
from .shingles import mix64

#: Neighbours of each node in the graph.
DEGREE = 32
#: First graph: so many orders of the vectors by signs of random projections, each cut into leaves of so many, which are compared in
#: blocks of so many rows.
TREES, LEAF, BLOCK = 4, 4096, 512
#: Members of a local join: the node's nearest, and a sample of those that have it as a neighbour.
NEAREST, REVERSE = 20, 12
#: New neighbours that a node can be offered by one local join.
OFFERS = 8
#: Rounds of descent at most; they end before if fewer than one edge in so many changes.
ROUNDS, SETTLED = 4, 8
#: Candidates that a walk keeps: BEAM at least, and GROWTH times the cube root of the number of nodes; how many of them it expands at a time.
BEAM, GROWTH, WIDTH = 128, 4, 128
#: Nodes that every walk visits besides its own neighbours at the start.
ENTRIES = 8
#: So many queries are also answered exactly; while their walks find a smaller share of the neighbours than this, beams are doubled.
AUDIT, RECALL = 200, 0.95
#: Queries that one exact scan answers, and nodes that it compares at a time.
LOT, CHUNK = 2048, 512
#: Nodes that score the walks' candidates together, and walks that go on together.
NODES, WALKS = 4096, 64
#: Cosines of unit vectors in single precision are nearer than this to those of the vectors themselves.
ERROR = 1e-6
#: Bytes of a partition that Python works through.
LOAD = 32 << 20


def _usable(value, dim: int | None) -> np.ndarray | None:
    """The vector as doubles, or none if it takes no part."""
    if value is None:
        return None
    x = np.array([np.nan if v is None else v for v in value], np.float64)
    if not len(x) or (dim is not None and len(x) != dim) or not np.isfinite(x).all():
        return None
    length = np.sqrt((x * x).sum())
    return x if length > 0 and np.isfinite(length) else None


def _prepare(dim: int, seed: int):
    """(vec_id, embedding) -> vec_id, vec (doubles), code (unit vector in single precision), key (names equal vectors), leaf keys."""
    planes = np.random.default_rng(seed).standard_normal((TREES, dim, 62)).astype(np.float32)
    bits = (np.int64(1) << np.arange(61, -1, -1, dtype=np.int64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, codes, keys, leaves = [], [], [], [], []
            for vec_id, value in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                x = _usable(value, dim)
                if x is not None:
                    raw = (x + 0.0).tobytes()
                    ids.append(vec_id)
                    vecs.append(raw)
                    keys.append(xxhash.xxh3_128_digest(raw))
                    unit = x / np.sqrt((x * x).sum())
                    codes.append(unit.astype(np.float32).tobytes())
            if ids:
                unit = np.frombuffer(b"".join(codes), np.float32).reshape(len(ids), dim)
                signs = np.stack([((unit @ p) > 0) @ bits for p in planes], axis=1)
                leaves = signs.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(codes, pa.binary()), pa.array(keys, pa.binary()), pa.array(leaves, pa.list_(pa.int64()))],
                ["vec_id", "vec", "code", "key", "leaves"],
            )

    return run


def _matrix(codes: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision. Their dot products tell near copies apart as finely as single precision holds the
    components themselves, much finer than dot products of single precision do."""
    x = _floats(codes, np.float32).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _edges(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], ["u", "v", "sim"])


def _whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows in the order of a column -> the same rows, those with one value of it never apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        x = batch.column(column).to_numpy()
        before = np.flatnonzero(x != x[-1])
        if len(before):
            cut = int(before[-1]) + 1
        elif len(held) > 1 and held[-2].column(column)[-1].as_py() != x[-1]:
            cut = 0
        else:
            continue
        held[-1] = batch.slice(0, cut)
        if rows := [h for h in held if len(h)]:
            yield pa.Table.from_batches(rows).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _leaves(top: int):
    """Rows of (leaf, node, code), those of one leaf together -> the nearest within each leaf, found in single precision."""

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x, y = rows.column("node").to_numpy(), _floats(rows.column("code"), np.float32), _matrix(rows.column("code"))
        k = min(top, len(ids) - 1)
        for a in range(0, len(ids), BLOCK):
            far = -(x[a : a + BLOCK] @ x.T)
            far[np.arange(len(far)), np.arange(a, a + len(far))] = 2
            best = np.argpartition(far, k - 1, axis=1)[:, :k]
            yield _edges(np.repeat(ids[a : a + BLOCK], k), ids[best.ravel()], np.einsum("id,ijd->ij", y[a : a + BLOCK], y[best]).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, "leaf"):
            leaf = rows.column("leaf").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(leaf)), strict=True):
                if b - a > 1:
                    yield from one(rows.slice(a, b - a))

    return run


def _local_joins():
    """Rows of (w, node, code, floor, new), those of one w together -> for each member the nearest other members that are
    nearer than its farthest neighbour, of pairs in which one is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, "w"):
            yield from joined(rows)

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        w, ids = rows.column("w").to_numpy(), rows.column("node").to_numpy()
        floor, new = rows.column("floor").to_numpy(), rows.column("new").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        ends = np.append(starts[1:], len(w))
        codes = _matrix(rows.column("code"))
        us, vs, sims = [], [], []
        size = 0
        for a, b in zip(starts, ends, strict=True):
            if b - a < 2 or not new[a:b].any():
                continue
            x = codes[a:b]
            s = x @ x.T
            mine = ids[a:b]
            s[~(new[a:b, None] | new[None, a:b]) | (mine[:, None] == mine[None, :]) | (s <= floor[a:b, None])] = -2
            k = min(OFFERS, len(x) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(s, best, 1)
            i, j = np.nonzero(value > -2)
            us.append(mine[i])
            vs.append(mine[best[i, j]])
            sims.append(value[i, j])
            size += len(i)
            if size > 200_000:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(sims))
                us, vs, sims, size = [], [], [], 0
        if us:
            yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(sims))

    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u, equal edges once; ties to the smaller id. rank is from 1."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def _grouped(df: DataFrame, column: str, size: int) -> DataFrame:
    """The rows with one value of a column together, in partitions of about LOAD bytes of `size` in all."""
    return df.repartition(max(1, -(-size // LOAD)), column).sortWithinPartitions(column)


def _ordered(nodes: DataFrame, many: int, scratch: Scratch) -> DataFrame:
    """(leaf, node) for all trees. A tree orders the nodes by its leaf key and cuts them into halves of leaves by their place, however Spark
    deals out the rows; a leaf is two halves in a row, so every half is linked with the ones beside it."""
    n = max(1, -(-many * TREES * 32 // LOAD))
    keys = nodes.select("node", F.posexplode("leaves").alias("tree", "key")).withColumn("tie", F.xxhash64("node", "tree"))
    keys = keys.repartitionByRange(n, "tree", "key", "tie", "node").sortWithinPartitions("tree", "key", "tie", "node")
    placed = scratch.keep(keys.select("tree", "node", F.monotonically_increasing_id().alias("at")), "order")
    # partition and row of each place: a count for each partition makes them places in the whole order
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    parts = F.broadcast(parts.select("part", before.alias("before")))
    placed = placed.join(parts, F.shiftright("at", 33) == F.col("part"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("tree") * many
    halves = max(1, round(many / (LEAF // 2)))  # of even size, and at least one whole leaf
    half = F.floor(place * halves / many).cast("long")
    leaf = F.array(half, half - 1) if halves > 1 else F.array(half)
    leaf = F.filter(leaf, lambda x: (x >= 0) & (x < max(1, halves - 1)))
    return placed.select("tree", "node", F.explode(leaf).alias("leaf")).select((F.col("tree") * halves + F.col("leaf")).alias("leaf"), "node")


class Index:
    """nodes: one row for each different vector (node, its smallest vec_id; vec; code), `many` in all. members: (node, vec_id) of all.
    graph: (u, v, sim, rank). recall: what the last `nearest` measured."""

    def __init__(self, nodes: DataFrame, members: DataFrame, graph: DataFrame, dim: int, many: int, degree: int, scratch: Scratch):
        self.nodes, self.members, self.graph, self.dim, self.many, self.degree, self.scratch = nodes, members, graph, dim, many, degree, scratch
        self.recall: float | None = None
        self._lists: DataFrame | None = None

    @property
    def parts(self) -> int:
        return max(1, -(-self.many // NODES))

    def lists(self) -> DataFrame:
        """(part, node, code, nbrs): each node's neighbours and a sample, as many at most, of those that it is a neighbour of."""
        if self._lists is None:
            ahead = self.graph.select(F.col("u").alias("node"), F.col("v").alias("next"))
            back = self.graph.select(F.col("v").alias("node"), F.col("u").alias("next"))
            nth = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "next")))
            back = back.withColumn("nth", nth).where(F.col("nth") <= self.degree).drop("nth")
            nbrs = ahead.unionByName(back).groupBy("node").agg(F.collect_set("next").alias("nbrs"))
            lists = self.nodes.select("node", "code").join(nbrs, "node", "left")
            lists = map_arrow(lists, _placed(self.parts, 2 * self.degree), "part int, node long, code binary, nbrs binary")
            self._lists = self.scratch.keep(lists, "lists")
        return self._lists


def build(vectors: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 7) -> Index | None:
    """An index of all rows of (vec_id, embedding); none if no vector takes part.

    Vectors take no part if they are null or zero, have null or non-finite components, another length than most, or no
    vec_id. Equal vectors are one node, so a vector that very many rows share is met once. The first graph comes from leaves of
    vectors whose random projections agree in sign; then, in each round, every node joins its neighbours and a bounded sample of the
    nodes it is a neighbour of, pair by pair, and each offers the other a place in its list: neighbours of neighbours
    become neighbours. Joins work on unit vectors of single precision; ids and those alone are shuffled, in partitions sized by rows and
    bytes. A node that very many others have as a neighbour sends on a few rows from each task."""
    scratch = Scratch(vectors.sparkSession, "ann")
    vectors = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0]["n"]
    rows = map_arrow(vectors, _prepare(dim, seed), "vec_id long, vec binary, code binary, key binary, leaves array<long>")
    rows = scratch.keep(rows, "vectors")
    # each task sends on one row of equal vectors
    heads = scratch.keep(rows.groupBy("key").agg(F.min_by(F.struct(F.col("vec_id").alias("node"), "vec", "code", "leaves"), "vec_id").alias("x")).select("key", "x.*"), "heads")
    members = scratch.keep(rows.select("vec_id", "key").join(heads.select("key", "node"), "key").select("node", "vec_id"), "members")
    nodes = heads.drop("key")
    scratch.drop(rows)
    many = nodes.count()
    if not many:
        return None

    row = 4 * dim + 32
    leaves = _ordered(nodes, many, scratch).join(nodes.select("node", "code"), "node").select("leaf", "node", "code")
    first = map_arrow(_grouped(leaves, "leaf", 2 * TREES * many * row), _leaves(degree // 2), "u long, v long, sim double")
    first = first.repartition(max(1, -(-many * TREES * degree * 24 // LOAD)), "u").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    graph = scratch.keep(_nearest(first, degree).withColumn("new", F.lit(True)), "graph")
    codes = nodes.select("node", "code")
    for _ in range(rounds):
        floor = graph.where(F.col("rank") == degree).select(F.col("u").alias("node"), F.col("sim").alias("floor"))
        near = graph.where(F.col("rank") <= NEAREST).select(F.col("u").alias("w"), F.col("v").alias("node"), "new")
        back = graph.select(F.col("v").alias("w"), F.col("u").alias("node"), "new", F.xxhash64("u", "v").alias("h"))
        nth = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("new"), "h"))
        back = back.withColumn("nth", nth).where(F.col("nth") <= REVERSE).select("w", "node", "new")
        size = many * (NEAREST + REVERSE)
        both = near.unionByName(back).repartition(max(1, -(-size * row // LOAD)), "node").groupBy("w", "node").agg(F.max("new").alias("new"))
        both = both.join(codes, "node").join(floor, "node", "left").select("w", "node", "code", F.coalesce("floor", F.lit(-2.0)).alias("floor"), "new")
        offered = map_arrow(_grouped(both, "w", size * row), _local_joins(), "u long, v long, sim double")
        merged = graph.select("u", "v", "sim", F.lit(False).alias("new")).unionByName(offered.withColumn("new", F.lit(True)))
        merged = merged.repartition(max(1, -(-many * 4 * degree * 25 // LOAD)), "u").groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        old, graph = graph, scratch.keep(_nearest(merged, degree), "graph")
        scratch.drop(old)
        total, fresh = graph.agg(F.count("*"), F.coalesce(F.sum(F.col("new").cast("long")), F.lit(0))).first()
        if fresh * SETTLED < total:
            break
    return Index(nodes, members, graph, dim, many, degree, scratch)


def _part(nodes: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(nodes.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _placed(parts: int, width: int):
    """(node, code, nbrs) -> the same with part, nbrs as `width` ids (-1 behind the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            raw = []
            for ids in batch.column("nbrs").to_pylist():
                ids = sorted(ids or ())[:width]
                raw.append(np.array(ids + [-1] * (width - len(ids)), np.int64).tobytes())
            columns = [pa.array(_part(node, parts)), batch.column("node"), batch.column("code"), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "node", "code", "nbrs"])

    return run


#: A walk: its unit vector; nodes of its beam, nearest first, their similarities, whether they are still to be expanded, and the
#: neighbours of those; all nodes seen; the similarity that a candidate must exceed; and what it asks which part of the nodes for.
STATE = "query long, lot int, q binary, nodes binary, sims binary, todo binary, nbrs binary, seen binary, floor double, parts array<int>, asks array<binary>"
_STATE = ["query", "lot", "q", "nodes", "sims", "todo", "nbrs", "seen", "floor", "parts", "asks"]


def _state(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.float64(), pa.list_(pa.int32()), pa.list_(pa.binary())]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], _STATE)


def _asks(ids: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    to = _part(ids, parts)
    order = np.argsort(to, kind="stable")
    names, first = np.unique(to[order], return_index=True)
    return names.tolist(), [x.tobytes() for x in np.split(ids[order], first[1:])] if len(ids) else []


def _start(parts: int, lots: int, entries: list[int]):
    """(node, code, nbrs) of the queries' own nodes -> their walks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            node, rows = batch.column("node").to_numpy(), []
            lot = _part(node, lots)
            for n, q, nbrs in zip(node.tolist(), batch.column("code").to_pylist(), _floats(batch.column("nbrs"), np.int64), strict=True):
                ids = np.unique(np.concatenate((nbrs[nbrs >= 0], np.array(entries, np.int64))))
                ids = ids[ids != n]
                own = np.array([n], np.int64)
                rows.append((n, int(lot[len(rows)]), q, own.tobytes(), np.array([2.0]).tobytes(), b"\0", b"", np.append(ids, own).tobytes(), -2.0, *_asks(ids, parts)))
            yield from _state(rows).to_batches()

    return run


def _answer(nodes: pa.Table, asked: pa.Table) -> pa.Table:
    """Of one part: each walk's candidates that exceed its floor, with their similarities and neighbours."""
    out: list[tuple] = []
    if len(nodes) and len(asked):
        ids = nodes.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x, nbrs = ids[order], _matrix(nodes.column("code"))[order], _floats(nodes.column("nbrs"), np.int64)[order]
        q, floor = _matrix(asked.column("q")), asked.column("floor").to_numpy()
        for i, (lot, query, ask) in enumerate(zip(*[asked.column(c).to_pylist() for c in ("lot", "query", "ids")], strict=True)):
            at = np.searchsorted(ids, np.frombuffer(ask, np.int64))
            sims = x[at] @ q[i]
            good = sims > floor[i]
            if good.any():
                out.append((lot, query, ids[at[good]].tobytes(), sims[good].tobytes(), nbrs[at[good]].tobytes()))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["lot", "query", "nodes", "sims", "nbrs"])


def _go_on(beam: int, width: int, parts: int, degree: int):
    """Walks of one lot and what they have been answered -> the walks one step on."""

    def step(walk: dict, found: list[dict]) -> tuple:
        nodes, sims = [np.frombuffer(walk["nodes"], np.int64)], [np.frombuffer(walk["sims"], np.float64)]
        todo, nbrs = [np.frombuffer(walk["todo"], bool)], [np.frombuffer(walk["nbrs"], np.int64).reshape(-1, 2 * degree)]
        for f in found:
            nodes.append(np.frombuffer(f["nodes"], np.int64))
            sims.append(np.frombuffer(f["sims"], np.float64))
            todo.append(np.ones(len(nodes[-1]), bool))
            nbrs.append(np.frombuffer(f["nbrs"], np.int64).reshape(-1, 2 * degree))
        nodes, sims, todo, nbrs = (np.concatenate(x) for x in (nodes, sims, todo, nbrs))
        row = np.cumsum(todo) - 1
        order = np.lexsort((nodes, -sims))[:beam]
        nodes, sims, todo, row = nodes[order], sims[order], todo[order].copy(), row[order]
        seen, ids = np.frombuffer(walk["seen"], np.int64), np.zeros(0, np.int64)
        while not len(ids) and todo.any():
            front = np.flatnonzero(todo)[:width]
            todo[front] = False
            ids = np.setdiff1d(nbrs[row[front]], seen)
            ids = ids[ids >= 0]
        floor = float(sims[-1]) if len(sims) == beam else -2.0
        rest = nbrs[row[todo]]
        return (walk["query"], walk["lot"], walk["q"], nodes.tobytes(), sims.tobytes(), todo.tobytes(), rest.tobytes(), np.append(seen, ids).tobytes(), floor, *_asks(ids, parts))

    def run(walks: pa.Table, found: pa.Table) -> pa.Table:
        answers: dict[int, list[dict]] = {}
        for f in found.to_pylist():
            answers.setdefault(f["query"], []).append(f)
        return _state([step(w, answers.get(w["query"], [])) for w in walks.to_pylist()])

    return run


def _best(k: int):
    """Walks -> (query, node) of what may be among the k nearest others of each by exact cosines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, found = [], []
            for query, nodes, sims in zip(*[batch.column(c).to_pylist() for c in ("query", "nodes", "sims")], strict=True):
                sims = np.frombuffer(sims, np.float64)
                some = np.frombuffer(nodes, np.int64)[sims >= sims[min(k, len(sims) - 1)] - ERROR]
                queries.append(np.full(len(some), query, np.int64))
                found.append(some)
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *queries])), pa.array(np.concatenate([none, *found]))], ["query", "node"])

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosine in double precision of rows of (query, node, x, y)."""
    for batch in batches:
        for first in range(0, len(batch), 4096):
            b = batch.slice(first, 4096)
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float64).reshape(len(b), -1) for c in ("x", "y"))
            score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(score, pa.float64())], ["query", "node", "score"])


def _scan(shared, most: int):
    """Rows of (node, vec) in the order of node -> the `most` nearest of each query among them; ties to the smaller node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        sims, nodes = np.full((len(names), most), -np.inf), np.zeros((len(names), most), np.int64)
        for batch in batches:
            for first in range(0, len(batch), CHUNK):
                b = batch.slice(first, CHUNK)
                x = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float64).reshape(len(b), -1)
                s = q @ (x / np.sqrt((x * x).sum(1, keepdims=True))).T
                i, j = np.nonzero(s > sims[:, -1:])
                if not len(i):
                    continue
                rows = np.unique(i)
                who = np.concatenate((np.repeat(rows, most), i))
                sim = np.concatenate((sims[rows].ravel(), s[i, j]))
                node = np.concatenate((nodes[rows].ravel(), b.column("node").to_numpy()[j]))
                order = np.lexsort((node, -sim, who))
                who = who[order]
                best = order[np.arange(len(who)) - np.searchsorted(who, who) < most]
                sims[rows], nodes[rows] = sim[best].reshape(-1, most), node[best].reshape(-1, most)
        i, j = np.nonzero(sims > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(nodes[i, j]), pa.array(sims[i, j])], ["query", "node", "sim"])

    return run


def exact(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """As search, by comparing every query with every node: lots of queries go to the executors, each scans its nodes."""
    spark, scratch = index.nodes.sparkSession, index.scratch
    asked = _asked(index, queries)
    vecs = index.nodes.select("node", "vec")
    walks = scratch.keep(asked.select("node").distinct().join(vecs, "node"), "asked")
    lots = -(-walks.count() // LOT)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "node"))
    found = None
    for lot in range(lots):
        q = walks.where(F.pmod(F.xxhash64("node"), F.lit(lots)) == lot).toArrow()
        if not len(q):
            continue
        x = np.frombuffer(b"".join(q.column("vec").to_pylist()), np.float64).reshape(len(q), -1)
        shared = spark.sparkContext.broadcast((q.column("node").to_numpy(), x / np.sqrt((x * x).sum(1, keepdims=True))))
        near = map_arrow(vecs.sortWithinPartitions("node"), _scan(shared, 2 * k + 2), "query long, node long, sim double")
        near = scratch.keep(near.withColumn("nth", best).where(F.col("nth") <= 2 * k + 2).select("query", "node"), "exact")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = walks.select(F.col("node").alias("query"), "node")
    return _answers(index, asked, found, k)


def nearest(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """As search, with the walks of AUDIT queries held against exact answers: while they find too few neighbours, all queries walk again
    with beams of twice the width, at last with beams that hold every node. What was found is in index.recall."""
    some = index.scratch.keep(_asked(index, queries).select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT), "audit")
    right: dict[int, list[float]] = {}
    for r in exact(index, some, k).collect():
        right.setdefault(r.query_id, []).append(r.score)
    beam = beam_of(index.many)
    while True:
        walked = index.scratch.keep(search(index, queries, k, beam), "walked")
        hits = sum(r.score >= min(right[r.query_id]) - 1e-15 for r in walked.join(F.broadcast(some), "query_id").collect())
        index.recall = hits / max(1, sum(map(len, right.values())))
        if not right or index.recall >= RECALL or beam > index.many:
            return walked
        beam *= 2


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    return queries.select("query_id").distinct().join(index.members, F.col("query_id") == F.col("vec_id")).select("query_id", "node").distinct()


def beam_of(many: int) -> int:
    return max(BEAM, int(np.ceil(GROWTH * many ** (1 / 3))))


def search(index: Index, queries: DataFrame, k: int = 5, beam: int | None = None, width: int = WIDTH) -> DataFrame:
    """(query_id) of rows of the index -> query_id, rank, vec_id, score of the k nearest other rows.

    Each query starts at its own node's neighbours and a few others, and in every step expands the nearest nodes of its beam that it has
    not yet: their neighbours that it has not seen are candidates, and the nearest `beam` of all stay. A step goes to the nodes with the
    walk's vector, one row for each part of the nodes and walk, and only what enters the beam comes back. Walks end when nothing in
    the beam is unexpanded. Then the nearest, and all that single precision cannot tell from them, are scored by the cosine of the
    original vectors in double precision, nodes stand for all rows with their vector, and ties go to the smaller vec_id."""
    scratch, beam = index.scratch, max(k + 1, beam or beam_of(index.many))
    ship_package(index.nodes.sparkSession)
    asked, lists = _asked(index, queries), index.lists()
    # queries with one vector walk once
    own = asked.select("node").distinct().join(lists, "node")
    lots = max(1, -(-asked.count() // WALKS))
    entries = [r.node for r in lists.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node").collect()]
    state = scratch.keep(map_arrow(own.select("node", "code", "nbrs"), _start(index.parts, lots, entries), STATE), "state")
    go_on = _go_on(beam, width, index.parts, index.degree)
    while not state.where(F.size("asks") > 0).isEmpty():
        asks = state.select("lot", "query", "q", "floor", F.explode(F.arrays_zip("parts", "asks")).alias("x"))
        asks = asks.select(F.col("x.parts").alias("part"), "lot", "query", "q", "floor", F.col("x.asks").alias("ids"))
        found = lists.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(_answer, "lot int, query long, nodes binary, sims binary, nbrs binary")
        on = state.groupBy("lot").cogroup(found.groupBy("lot")).applyInArrow(go_on, STATE)
        old, state = state, scratch.keep(on, "state")
        scratch.drop(old)
    return _answers(index, asked, map_arrow(state.select("query", "nodes", "sims"), _best(k), "query long, node long"), k)


def _answers(index: Index, asked: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query among the nodes (query, node)."""
    vecs = index.nodes.select("node", "vec")
    pairs = state.select("query", "node").join(vecs.select(F.col("node"), F.col("vec").alias("y")), "node")
    pairs = pairs.join(vecs.select(F.col("node").alias("query"), F.col("vec").alias("x")), "query").select("query", "node", "x", "y")
    scored = map_arrow(pairs, _scores, "query long, node long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    scored = scored.withColumn("nth", best).where(F.col("nth") <= k + 1).drop("nth")
    return answers(index.members, asked, scored, k)
