"""Operator 13: approximate nearest neighbours by inner product, over a neighbour graph.

Method: NN-descent. Every distinct vector is a node with a list of LINKS nearest nodes so far. Lists begin with what
a few random orders bring together, then each round joins a node's new neighbours with *their* neighbours, scores
the nodes so found, and lets both sides of a pair keep the better ones, until few lists still change. A query walks
the graph greedily: it keeps a beam of BEAM best nodes, expands the best STEP not yet expanded by one join for all
queries at once, and ends when its whole beam is expanded. Queries that are rows of the table start at their own
node besides the common entry points.

Nodes are numbered in the order of random-projection signs, so that near ones often have near numbers, and numbers
are cut into blocks of BLOCK. Scores are computed where a block's vectors are: a node sends its vector once to
each block in which it has candidates, never once for each pair, and PACK nodes' requests to a block travel as a row.
Requests of a block are dealt to COPIES copies of it.
Lists, beams and blocks are bounded, so is each task's memory; nothing but counts reaches the driver.

Inner products of vectors of unequal length are no distance. For the graph alone, such vectors get one more
coordinate that makes all lengths equal (searched scores are always of the vectors as given, in double precision).

Defined results: a vector that is null, empty, zero, holds a null or non-finite entry, or has another length than
most, takes no part; neither does a row without an id. Repeated rows count once; an id with several vectors is as many
candidates and queries. Equal vectors are one node, whose smallest ids are given, so ties go to the smaller id whatever
the number of copies. Fewer candidates than asked for give them all where the graph reaches them; an empty table
gives no rows. Columns other than the id and the vector are not read.

The index holds every row. It is approximate in two ways: lists keep LINKS neighbours, and of the nodes that list a
node the best LINKS are walked back to. The tests measure the recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import ranked, slices, written
from tracefold.operators.ordering import top_k

LINKS, FRESH = 32, 12
#: Rows of a random order that are compared with each other, and the number of such orders.
CHUNK, ORDERS, BITS = 2048, 8, 24
BLOCK, COPIES, PACK = 4096, 2, 64
BEAM, STEP, ENTRIES = 400, 96, 64
#: The graph is done when a round changes at most this share of all links, or after so many rounds.
SETTLED, MOST_ROUNDS = 0.1, 12
#: Nodes for which a task is worth its start; with few nodes there are not many more tasks than cores.
TASK_NODES = 2000
SEED = 20_413

#: A row of a block's table (kind 0: key, vec or ids, bars) or a pack of requests to the block (kind 1): the ids asked for
#: by each of ``keys`` lie one after another, ``counts`` of them each; ``vec`` and ``bars`` have an entry for each key.
MEET = "block bigint, salt int, kind int, key bigint, keys binary, vec binary, ids binary, counts binary, bars binary"
REQUEST = "block bigint, salt int, key bigint, keys binary, vec binary, ids binary, counts binary, bars binary"
FOUND = "key bigint, ids binary, sims binary"
LISTS = "key bigint, ids binary"


# --------------------------------------------------------------------------- arrays in binary columns
def unpack(col: pa.Array, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", dtype) for x in col.to_pylist()]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def best(groups: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Positions of each group's ``most`` best different ids, by group, falling score and id; of an id's entries the first."""
    by = np.lexsort((np.arange(len(ids)), ids, groups))
    g, i = groups[by], ids[by]
    by = by[np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]] if len(by) else by
    by = by[np.lexsort((ids[by], -sims[by], groups[by]))]
    g = groups[by]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return by[rank < most]


def _cuts(sorted_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]]) if len(sorted_groups) else np.zeros(0, int)
    return at, np.r_[at[1:], len(sorted_groups)] if len(at) else at


def _whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` sorted rows in which no key is cut; a key has a bounded number of rows."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, rows):
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.concat_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))      # keys ascend inside a partition
            if cut:
                yield table.slice(0, cut)
            held = [table.slice(cut)]
    if held:
        yield pa.concat_batches(held)


# --------------------------------------------------------------------------- vectors
@dataclass(frozen=True)
class Shape:
    """What tasks need to know: the entries' type in ``vec``, their number, that of the nodes, and the sizes in use."""
    dtype: str
    dim: int
    size: int
    chunk: int = CHUNK
    orders: int = ORDERS
    block: int = BLOCK

    @property
    def id_type(self) -> str:
        return "<u4" if self.size < 2 ** 32 else "<i8"


@dataclass(frozen=True)
class Vectors:
    """``members``: id, node; ``nodes``: key (from 0 without gaps), vec."""
    members: DataFrame
    nodes: DataFrame
    shape: Shape


def signs(rows: DataFrame, dtype: str, dim: int, seed: int) -> DataFrame:
    """``rows`` with ``code``: the sides of BITS random hyperplanes on which a vector lies."""
    planes = np.random.default_rng(seed).normal(size=(dim, BITS))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            v = np.frombuffer(b"".join(batch.column("vec").to_pylist()), dtype).reshape(-1, dim)
            code = (v @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(mark, f"{own}, code bigint")


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **sizes: int) -> Vectors | None:
    """Rows that take part, their distinct vectors numbered; None if there are none."""
    dtype = "<f4" if df.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    element = "float" if dtype == "<f4" else "double"
    v = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{element}>").alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = v.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda c: c != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            values = lists.values.to_numpy(zero_copy_only=False).astype(dtype) + 0      # -0 is 0
            raw, at = values.tobytes(), int(dtype[2]) * lists.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "vec"])

    rows = v.mapInArrow(pack, "id bigint, vec binary")
    lengths = rows.groupBy(F.octet_length("vec").alias("b")).count().orderBy(F.desc("count"), F.desc("b")).limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0]["b"] // int(dtype[2])
    rows = rows.filter(F.octet_length("vec") == lengths[0]["b"])
    coded = signs(rows.select("vec").distinct(), dtype, dim, SEED).withColumn("tree", F.lit(""))
    nodes = written(ranked(coded, [F.col("code"), F.xxhash64("vec"), F.col("vec")], "ann-order").select(F.col("pos").alias("key"), "vec"), "ann-nodes")
    members = written(rows.distinct().join(nodes, "vec").select("id", F.col("key").alias("node")), "ann-members")
    return Vectors(members, nodes, Shape(dtype, dim, nodes.count(), **sizes))


def level(v: Vectors) -> Vectors:
    """Vectors of equal length for the graph: as they are if they have it, else with one more coordinate."""
    sh = v.shape
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), sh.dtype).reshape(-1, sh.dim).astype(float)
            yield _batch("s double", [np.sqrt((x * x).sum(1))])

    low, high = v.nodes.mapInArrow(lengths, "s double").agg(F.min("s"), F.max("s")).first()
    if high - low <= 1e-5 * high:
        return v

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), sh.dtype).reshape(-1, sh.dim).astype(float) / high
            x = np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))].astype("<f4")
            yield _batch("key bigint, vec binary", [batch.column("key"), [r.tobytes() for r in x]])

    return Vectors(v.members, v.nodes.mapInArrow(widen, "key bigint, vec binary"), replace(sh, dtype="<f4", dim=sh.dim + 1))


def dealt(rows: DataFrame, nodes: int, *by: str) -> DataFrame:
    """``rows`` dealt out by a key to at most as many tasks as ``nodes`` give work to, however many shuffle partitions there are."""
    most = max(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-nodes // TASK_NODES))
    return rows.repartition(*by).coalesce(most)


# --------------------------------------------------------------------------- requests meet blocks
def packed(sh: Shape, rows: list[tuple[int, bytes, float, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Requests (key, vec, bar, sorted ids), dealt to the ids' blocks, PACK keys to a row."""
    out = []
    for at in range(0, len(rows), PACK):
        part = rows[at:at + PACK]
        who = np.repeat(np.arange(len(part)), [len(r[3]) for r in part])
        ids = np.concatenate([r[3] for r in part]).astype(np.int64)
        keys, bars = np.array([r[0] for r in part], "<i8"), np.array([r[2] for r in part], "<f8")
        vecs = np.frombuffer(b"".join(r[1] for r in part), np.uint8).reshape(len(part), -1) if part[0][1] else np.zeros((len(part), 0), np.uint8)
        by = np.argsort(ids // sh.block, kind="stable")
        ids, who = ids[by], who[by]
        blocks = ids // sh.block
        for i, j in zip(*_cuts(blocks), strict=True):
            first, last = _cuts(who[i:j])
            them = who[i:j][first]
            out.append((int(blocks[i]), int(keys[0] // PACK % COPIES), int(keys[0]), keys[them].tobytes(), vecs[them].tobytes(), ids[i:j].astype(sh.id_type).tobytes(),
                        (last - first).astype("<i4").tobytes(), bars[them].tobytes()))
    if out:
        yield _batch(REQUEST, list(zip(*out, strict=True)))


def unpacked(sh: Shape, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None, float, np.ndarray]]:
    """Key, vector (None if packed without), bar and ids of each request."""
    for keys, vecs, ids, counts, bars in zip(*(batch.column(c).to_pylist() for c in ("keys", "vec", "ids", "counts", "bars")), strict=True):
        keys, ids, bars = np.frombuffer(keys, "<i8"), np.frombuffer(ids, sh.id_type), np.frombuffer(bars, "<f8")
        to = np.cumsum(np.frombuffer(counts, "<i4"))
        x = np.frombuffer(vecs, sh.dtype).reshape(len(keys), -1) if vecs else None
        for k, key in enumerate(keys.tolist()):
            yield key, None if x is None else x[k], float(bars[k]), ids[to[k - 1] if k else 0:to[k]]


def _meet(sh: Shape, table: DataFrame, requests: DataFrame, build: Callable, serve: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """Bring the rows of ``table`` (key and what a node has) and the requests of its block together in a task.

    ``build(first key, batch)`` makes a block's state, ``serve(state, batch)`` answers a batch of requests, ``finish`` ends it.
    """
    size = sh.block
    copies = table.withColumn("block", F.floor(F.col("key") / size).cast("bigint")).withColumn("kind", F.lit(0))
    copies = copies.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(COPIES)])))
    both = copies.unionByName(requests.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    for f in MEET.split(", "):
        name, kind = f.split()
        both = both.withColumn(name, (F.col(name) if name in both.columns else F.lit(None)).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, state = None, [], None
        for batch in slices(batches, 512):
            b, s, k = (batch.column(c).to_numpy() for c in ("block", "salt", "kind"))
            at, to = _cuts((b * COPIES + s) * 2 + k)
            for i, j in zip(at, to, strict=True):
                if (b[i], s[i]) != now:
                    if state is not None and finish:
                        yield from finish(state)
                    now, rows, state = (b[i], s[i]), [], None
                if k[i] == 0:
                    rows.append(batch.slice(i, j - i))
                    continue
                if state is None:
                    state, rows = build(int(b[i]) * size, pa.concat_batches(rows)), []
                for part in slices([batch.slice(i, j - i)], 16):
                    yield from serve(state, part)
        if state is not None and finish:
            yield from finish(state)

    names = [f.split()[0] for f in MEET.split(", ")]
    return dealt(both.select(*names), sh.size, "block", "salt").sortWithinPartitions("block", "salt", "kind", "key").mapInArrow(run, schema)


def _lists_of(sh: Shape, table: DataFrame, requests: DataFrame) -> DataFrame:
    """``key, ids``: for each key and block, the nodes that the asked nodes there are linked to."""
    def build(first: int, batch: pa.RecordBatch):
        return first, unpack(batch.column("ids"), sh.id_type)

    def serve(state, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, lists = state
        out = [(key, np.unique(np.concatenate([lists[i] for i in ids.astype(np.int64) - first])).tobytes()) for key, _, _, ids in unpacked(sh, batch)]
        yield _batch(LISTS, list(zip(*out, strict=True)))

    return _meet(sh, table.select("key", "ids"), requests, build, serve, LISTS)


def _asked(sh: Shape, owners: DataFrame, lists: DataFrame, sims_type: str, full: int) -> DataFrame:
    """Requests for what ``lists`` found for each owner (``key, vec, ids, sims``) and it doesn't have, above its last score."""
    rows = owners.select("key", "vec", "ids", "sims", F.lit(0).alias("late")).unionByName(lists.withColumn("late", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, 1024):
            key, late = batch.column("key").to_numpy(), batch.column("late").to_numpy()
            ids, vec, sims = unpack(batch.column("ids"), sh.id_type), batch.column("vec").to_pylist(), unpack(batch.column("sims"), sims_type)
            out = []
            for i, j in zip(*_cuts(key), strict=True):
                if j - i > 1 and not late[i]:
                    new = np.setdiff1d(np.concatenate(ids[i + 1:j]), ids[i])
                    new = new[new != key[i]] if full == LINKS else new
                    if len(new):
                        out.append((int(key[i]), vec[i], float(sims[i][-1]) if len(sims[i]) == full else -np.inf, new))
            yield from packed(sh, out)

    return dealt(rows, sh.size, "key").sortWithinPartitions("key", "late").mapInArrow(run, REQUEST)


# --------------------------------------------------------------------------- the graph
def _first_lists(v: Vectors, seed: int) -> DataFrame:
    """``key, ids, sims``: the nearest of the rows beside a node in one random order; a chunk's pairs stay in its task."""
    sh = v.shape
    def near(key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        most = min(LINKS, len(key) - 1)
        pick = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most else np.zeros((len(key), 0), int)
        sims = np.take_along_axis(sims, pick, 1).astype("<f4")
        ids = key[pick].astype(sh.id_type)
        return _batch(FOUND, [key, [r.tobytes() for r in ids], [r.tobytes() for r in sims]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x = np.zeros(0, np.int64), np.zeros((0, sh.dim), np.float32)
        for batch in slices(batches, sh.chunk):
            key = np.concatenate([key, batch.column("key").to_numpy()])
            x = np.concatenate([x, np.frombuffer(b"".join(batch.column("vec").to_pylist()), sh.dtype).reshape(-1, sh.dim).astype(np.float32)])
            while len(key) >= 2 * sh.chunk:
                yield near(key[:sh.chunk], x[:sh.chunk])
                key, x = key[sh.chunk:], x[sh.chunk:]
        if len(key):
            yield near(key, x)

    coded = signs(v.nodes, sh.dtype, sh.dim, seed)
    by = [F.col("code"), F.xxhash64("key", F.lit(seed))]
    parts = max(1, min(sh.size // (2 * sh.chunk), int(v.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return coded.repartitionByRange(parts, *by).coalesce(parts).sortWithinPartitions(*by).drop("code").mapInArrow(run, FOUND)


GRAPH = "key bigint, vec binary, ids binary, sims binary, fresh binary, changed bigint"


def _merged(sh: Shape, graph: DataFrame, found: DataFrame) -> DataFrame:
    """The better LINKS of each node's list and what was found for it; new links are fresh, ``changed`` counts them."""
    id_type = sh.id_type
    rows = graph.select("key", "vec", "ids", "sims", "fresh", F.lit(0).alias("late")).unionByName(found.withColumn("late", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches):
            late, key = batch.column("late").to_numpy(), batch.column("key").to_numpy()
            ids, sims, fresh = unpack(batch.column("ids"), id_type), unpack(batch.column("sims"), "<f4"), unpack(batch.column("fresh"), "?")
            sizes = [len(x) for x in ids]
            g, i, s = np.repeat(key, sizes), np.concatenate(ids).astype(np.int64), np.concatenate(sims)
            n = np.repeat(late == 1, sizes)
            f = np.concatenate([np.ones(k, bool) if x == 1 else y for k, x, y in zip(sizes, late, fresh, strict=True)])
            keep = best(g, i, s, LINKS)         # of an id in the old list and among the found ones, the old entry stays
            g, i, s, f, n = g[keep], i[keep].astype(id_type), s[keep], f[keep], n[keep]
            own = np.flatnonzero(late == 0)
            spans = list(zip(np.searchsorted(g, key[own]).tolist(), np.searchsorted(g, key[own], side="right").tolist(), strict=True))
            yield _batch(GRAPH, [key[own], batch.column("vec").take(pa.array(own)), [i[a:b].tobytes() for a, b in spans], [s[a:b].tobytes() for a, b in spans],
                                 [f[a:b].tobytes() for a, b in spans], [int(n[a:b].sum()) for a, b in spans]])

    return dealt(rows, sh.size, "key").sortWithinPartitions("key", "late").mapInArrow(run, GRAPH)


def _paths(sh: Shape, graph: DataFrame) -> DataFrame:
    """Requests for the lists of each node's best fresh neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows = zip(batch.column("key").to_pylist(), unpack(batch.column("ids"), sh.id_type), unpack(batch.column("fresh"), "?"), strict=True)
            yield from packed(sh, [(key, b"", 0.0, np.sort(ids[f][:FRESH])) for key, ids, f in rows if f.any()])

    return graph.select("key", "ids", "fresh").mapInArrow(run, REQUEST)


def _marked(graph: DataFrame) -> DataFrame:
    """The graph after its best FRESH fresh links were used."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            fresh = [(f & (np.cumsum(f) > FRESH)).tobytes() for f in unpack(batch.column("fresh"), "?")]
            yield _batch(GRAPH, [*(batch.column(c) for c in ("key", "vec", "ids", "sims")), fresh, np.zeros(batch.num_rows, np.int64)])

    return graph.mapInArrow(mark, GRAPH)


class _Scores:
    """A block's vectors in one task, and the best links found for its own nodes."""
    def __init__(self, first: int, batch: pa.RecordBatch, dtype: str, dim: int):
        self.first, self.x = first, np.frombuffer(b"".join(batch.column("vec").to_pylist()), dtype).reshape(-1, dim).astype(np.float32)
        self.bar = np.frombuffer(b"".join(batch.column("bars").to_pylist()), "<f8").copy()
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def hold(self, w: np.ndarray, key: int, sims: np.ndarray) -> None:
        self.held.append((w, np.full(len(w), key), sims))
        self.count += len(w)
        if self.count > 400_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        w, ids, sims = (np.concatenate(x) for x in zip(*self.held, strict=True))
        keep = best(w, ids, sims, LINKS)
        w, ids, sims = w[keep], ids[keep], sims[keep]
        at, to = _cuts(w)
        full = to - at == LINKS
        self.bar[w[at[full]]] = np.maximum(self.bar[w[at[full]]], sims[to[full] - 1])
        self.held, self.count = [(w, ids, sims)], len(w)
        return w, ids, sims


def _found(sh: Shape, graph: DataFrame) -> DataFrame:
    """``key, ids, sims``: better links that a round found, for both ends of a pair."""
    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            s = [np.array([x[-1] if len(x) == LINKS else -np.inf], "<f8").tobytes() for x in unpack(batch.column("sims"), "<f4")]
            yield _batch("key bigint, vec binary, bars binary", [batch.column("key"), batch.column("vec"), s])

    def serve(state: _Scores, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for key, q, bar, ids in unpacked(sh, batch):
            w = ids.astype(np.int64) - state.first
            s = state.x[w] @ q.astype(np.float32)
            good = np.flatnonzero(s > bar)
            if len(good):
                good = good[np.argsort(-s[good], kind="stable")[:LINKS]]
                out.append((key, ids[good].tobytes(), s[good].tobytes()))
            good = s > state.bar[w]
            if good.any():
                state.hold(w[good], key, s[good])
        if out:
            yield _batch(FOUND, list(zip(*out, strict=True)))

    def finish(state: _Scores) -> Iterator[pa.RecordBatch]:
        w, ids, sims = state.settle()
        at, to = _cuts(w)
        spans = list(zip(at, to, strict=True))
        yield _batch(FOUND, [w[at] + state.first, [ids[a:b].astype(sh.id_type).tobytes() for a, b in spans], [sims[a:b].astype("<f4").tobytes() for a, b in spans]])

    asked = _asked(sh, graph, _lists_of(sh, graph, _paths(sh, graph)), "<f4", LINKS)
    table = graph.select("key", "vec", "sims").mapInArrow(bars, "key bigint, vec binary, bars binary")
    return _meet(sh, table, asked, lambda first, batch: _Scores(first, batch, sh.dtype, sh.dim), serve, FOUND, finish)


def descend(v: Vectors, most_rounds: int = MOST_ROUNDS, settled: float = SETTLED) -> DataFrame:
    """The neighbour graph: ``key, ids, sims`` (nearest first) of every node."""
    sh, none = v.shape, F.lit(b"")
    found = None
    for r in range(sh.orders):
        part = _first_lists(v, SEED + 1 + r)
        found = part if found is None else found.union(part)
    graph = written(_merged(sh, v.nodes.select("key", "vec", none.alias("ids"), none.alias("sims"), none.alias("fresh")), found), "ann-graph")
    for _ in range(most_rounds):
        graph = written(_merged(sh, _marked(graph), _found(sh, graph)), "ann-graph")
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        if changed <= settled * sh.size * LINKS:
            break
    return graph.select("key", "ids", "sims")


def two_way(v: Vectors, graph: DataFrame) -> DataFrame:
    """``key, ids``: a node's own links and, of the nodes that link to it, the best LINKS."""
    sh = v.shape
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            ids, sims = unpack(batch.column("ids"), sh.id_type), unpack(batch.column("sims"), "<f4")
            yield _batch("key bigint, id bigint, sim double", [np.concatenate(ids).astype(np.int64), np.repeat(batch.column("key").to_numpy(), [len(x) for x in ids]),
                                                               np.concatenate(sims).astype(float)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            both = [np.union1d(a, np.array(b or [], np.int64)).astype(sh.id_type) for a, b in zip(unpack(batch.column("ids"), sh.id_type), batch.column("back").to_pylist(), strict=True)]
            yield _batch("key bigint, ids binary", [batch.column("key"), [b.tobytes() for b in both]])

    back = top_k(graph.mapInArrow(links, "key bigint, id bigint, sim double"), ["key"], [F.col("sim").desc(), F.col("id").asc()], LINKS, "id", buckets=64)
    back = back.groupBy("key").agg(F.collect_list("id").alias("back"))
    return written(graph.join(back, "key", "left").select("key", "ids", "back").mapInArrow(join, "key bigint, ids binary"), "ann-links")


# --------------------------------------------------------------------------- search
STATE = "key bigint, vec binary, own bigint, ids binary, sims binary, done binary, next binary"


def _round(v: Vectors, links: DataFrame, state: DataFrame, beam: int, step: int) -> DataFrame:
    """One step of all queries: expand ``next`` in the graph, score what that finds, merge it into the beams."""
    sh = v.shape

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rows = zip(batch.column("key").to_pylist(), unpack(batch.column("next"), sh.id_type), strict=True)
            yield from packed(sh, [(key, b"", 0.0, np.sort(ids)) for key, ids in rows])

    lists = _lists_of(sh, links, state.select("key", "next").mapInArrow(expand, REQUEST))
    return _merged_beams(v, state, _scored(v, _asked(sh, state, lists, "<f8", beam), beam), beam, step)


def _scored(v: Vectors, requests: DataFrame, beam: int) -> DataFrame:
    """``key, ids, sims``: requested nodes whose inner product with the query, in double, is above the beam's last."""
    sh, kind = v.shape, v.shape.id_type

    def block(first: int, batch: pa.RecordBatch):
        return first, np.frombuffer(b"".join(batch.column("vec").to_pylist()), sh.dtype).reshape(-1, sh.dim).astype(float)

    def serve(state, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, x = state
        out = []
        for key, q, bar, ids in unpacked(sh, batch):
            s = np.einsum("ij,j->i", x[ids.astype(np.int64) - first], q.astype(float))
            good = np.flatnonzero(s >= bar)
            if len(good):
                good = good[np.lexsort((ids[good], -s[good]))[:beam]]
                out.append((key, ids[good].tobytes(), s[good].tobytes()))
        if out:
            yield _batch(FOUND, list(zip(*out, strict=True)))

    return _meet(sh, v.nodes, requests, block, serve, FOUND)


def _merged_beams(v: Vectors, state: DataFrame, found: DataFrame, beam: int, step: int) -> DataFrame:
    sh, kind = v.shape, v.shape.id_type
    rows = state.select("key", "vec", "own", "ids", "sims", "done", F.lit(0).alias("late")).unionByName(
        found.withColumn("late", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, 512):
            key, late = batch.column("key").to_numpy(), batch.column("late").to_numpy()
            ids, sims, done = unpack(batch.column("ids"), kind), unpack(batch.column("sims"), "<f8"), unpack(batch.column("done"), "?")
            sizes = [len(x) for x in ids]
            g, i, s = np.repeat(key, sizes), np.concatenate(ids).astype(np.int64), np.concatenate(sims)
            d = np.concatenate([np.zeros(k, bool) if x else y for k, x, y in zip(sizes, late, done, strict=True)])
            keep = best(g, i, s, beam)
            g, i, s, d = g[keep], i[keep].astype(kind), s[keep], d[keep]
            heads = np.flatnonzero(late == 0)
            at, to = np.searchsorted(g, key[heads]), np.searchsorted(g, key[heads], side="right")
            out = []
            for h, a, b in zip(heads.tolist(), at, to, strict=True):
                nxt = a + np.flatnonzero(~d[a:b])[:step]
                d[nxt] = True
                out.append((int(key[h]), batch.column("vec")[h].as_py(), batch.column("own")[h].as_py(), i[a:b].tobytes(), s[a:b].tobytes(), d[a:b].tobytes(), i[nxt].tobytes()))
            yield _batch(STATE, list(zip(*out, strict=True)) if out else [[]] * 7)

    return dealt(rows, sh.size, "key").sortWithinPartitions("key", "late").mapInArrow(run, STATE)


def search(v: Vectors, links: DataFrame, queries: DataFrame, most: int, beam: int = BEAM, step: int = STEP) -> DataFrame:
    """``key, node, score``: for each query (``key, vec, own`` node or null) its ``most`` best nodes and those that tie with the last."""
    sh, kind = v.shape, v.shape.id_type
    entries = np.unique(np.linspace(0, sh.size - 1, min(ENTRIES, sh.size)).astype(np.int64))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "vec", "own")), strict=True)
            yield from packed(sh, [(key, vec, -np.inf, entries if own is None else np.union1d(entries, [own])) for key, vec, own in rows])

    beam = max(beam, 4 * most)
    empty = F.lit(b"")
    state = queries.select("key", "vec", F.col("own").cast("bigint").alias("own"), empty.alias("ids"), empty.alias("sims"), empty.alias("done"))
    state = _merged_beams(v, state, _scored(v, queries.select("key", "vec", "own").mapInArrow(enter, REQUEST), beam), beam, step)
    finished = None
    while True:
        state = written(_round(v, links, state, beam, step) if finished is not None else state, "ann-beams")
        over = state.filter(F.octet_length("next") == 0)
        finished = over if finished is None else finished.union(over)
        state = state.filter(F.octet_length("next") > 0)
        if state.isEmpty():
            break

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            key, node, score = [], [], []
            for k, ids, sims in zip(batch.column("key").to_pylist(), unpack(batch.column("ids"), kind), unpack(batch.column("sims"), "<f8"), strict=True):
                n = len(sims) if len(sims) <= most else int(np.searchsorted(-sims, -sims[most - 1], side="right"))
                key.append(np.full(n, k))
                node.append(ids[:n].astype(np.int64))
                score.append(sims[:n])
            yield _batch("key bigint, node bigint, score double", [np.concatenate(x) for x in (key, node, score)])

    return finished.select("key", "ids", "sims").mapInArrow(give, "key bigint, node bigint, score double")


def nearest(df: DataFrame, is_query: Column, most: int, id_col: str = "vec_id", vec_col: str = "embedding", **sizes: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, its ``most`` nearest other rows."""
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    v = vectors(df, id_col, vec_col, **sizes)
    if v is None:
        return df.sparkSession.createDataFrame([], schema)
    asked = df.filter(F.coalesce(is_query, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id")).distinct()
    asked = v.members.join(asked, "id").select(F.col("id").alias("query_id"), F.col("node").alias("key"))
    links = two_way(v, descend(level(v)))
    starts = v.nodes.join(asked.select("key").distinct(), "key").withColumn("own", F.col("key"))
    found = search(v, links, written(starts, "ann-queries"), most + 1)
    # a node's smallest ids, one more than asked for as the query's own may be among them
    few = top_k(v.members, ["node"], [F.col("id").asc()], most + 1, "id", rank_col="at", buckets=64).select("node", "id")
    order = [F.col("score").desc(), F.col("id").asc()]
    named = found.join(few, "node").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("at") <= most + 1)
    pairs = asked.join(named.select("key", "node", "id", "score"), "key").filter((F.col("id") != F.col("query_id")) | (F.col("node") != F.col("key")))
    ranks = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order)))
    return ranks.filter(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
