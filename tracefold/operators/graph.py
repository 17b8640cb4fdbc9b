"""Provenance graph: nodes, edges, decision-scoped reads, walks, erasure
and similarity (JN3-JN6, JN11, JN13, AG13, ST3).

The graph is two kinds of tables: one node table per type and one unified
edge table ``(edge_type, from_type, from_id, to_type, to_id, ts)``. Reads are
joins over per-decision pre-aggregates, so every join side has at most one
row per decision. Written out, edges are partitioned by ``edge_type`` and
sorted by ``from_id`` so a walk reads only the edge types it follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import constants as C
from tracefold.operators.ordering import top_k
from tracefold.session import cut_lineage

EDGE_COLS = ("edge_type", "from_type", "from_id", "to_type", "to_id", "ts")
_EDGE_ENDS = {name: (f, t) for name, f, t in C.EDGE_TYPES}


def edges(df: DataFrame, edge_type: str, from_id: Column, to_id: Column, ts: Column | None = None) -> DataFrame:
    """Edges of one type from a producer frame (types checked against the fixed list)."""
    if edge_type not in _EDGE_ENDS:
        raise ValueError(f"unknown edge type {edge_type!r}")
    f, t = _EDGE_ENDS[edge_type]
    return df.select(F.lit(edge_type).alias("edge_type"), F.lit(f).alias("from_type"),
                     from_id.cast("string").alias("from_id"), F.lit(t).alias("to_type"),
                     to_id.cast("string").alias("to_id"),
                     (ts if ts is not None else F.lit(None)).cast("timestamp_ntz").alias("ts")
                     ).filter(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())


def edge_union(parts: Sequence[DataFrame]) -> DataFrame:
    """ST3: one edge table from every producer (missing columns become null)."""
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.select(*EDGE_COLS)


@dataclass(frozen=True)
class Edge:
    """An edge that each row of a source gives where both ids are there and ``when`` holds."""
    edge_type: str
    from_id: Column
    to_id: Column
    ts: Column | None = None
    when: Column | None = None


@dataclass(frozen=True)
class Node:
    """A node that each row of a source tells about: its id and what is known of it (name -> column)."""
    node_type: str
    node_id: Column
    props: Mapping[str, Column]
    when: Column | None = None


@dataclass(frozen=True)
class Source:
    """A table that edges and nodes come from; it is scanned once for all of its edges, and once for all of its nodes."""
    rows: DataFrame
    edges: Sequence[Edge] = ()
    nodes: Sequence[Node] = ()


def _present(ids: Sequence[Column], when: Column | None) -> Column:
    there = reduce(lambda a, b: a & b, [i.isNotNull() for i in ids])
    return there if when is None else there & F.coalesce(when, F.lit(False))


def source_edges(source: Source) -> DataFrame:
    """All edges of one source: an array of edge structs per row, those that hold exploded."""
    structs = []
    for e in source.edges:
        if e.edge_type not in _EDGE_ENDS:
            raise ValueError(f"unknown edge type {e.edge_type!r}")
        f, t = _EDGE_ENDS[e.edge_type]
        ts = (e.ts if e.ts is not None else F.lit(None)).cast("timestamp_ntz")
        structs.append(F.when(_present([e.from_id, e.to_id], e.when), F.struct(
            F.lit(e.edge_type).alias("edge_type"), F.lit(f).alias("from_type"), e.from_id.cast("string").alias("from_id"),
            F.lit(t).alias("to_type"), e.to_id.cast("string").alias("to_id"), ts.alias("ts"))))
    return source.rows.select(F.explode(F.array_compact(F.array(*structs))).alias("e")).select("e.*")


def build_edges(sources: Sequence[Source], types: Sequence[str] | None = None) -> DataFrame:
    """ST3/JN3: the edge table. Each source is scanned once, whatever the number of its edge types; no shuffle.

    With ``types`` only these are built, and sources of none of them are not read.
    """
    if types is not None:
        sources = [replace(s, edges=[e for e in s.edges if e.edge_type in types]) for s in sources]
    return edge_union([source_edges(s) for s in sources if s.edges])


def build_nodes(sources: Sequence[Source]) -> DataFrame:
    """JN3: ``node_type, node_id, props``: one row per node with what its sources tell, as JSON with sorted names.

    Of a property told differently the largest text counts, so the result doesn't depend on the order of rows. Facts are
    exploded in one pass per source and combined map-side, so a hot node costs no more than others.
    """
    parts = None
    for s in sources:
        structs = []
        for n in s.nodes:
            if n.node_type not in C.NODE_TYPES:
                raise ValueError(f"unknown node type {n.node_type!r}")
            facts = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in sorted(n.props.items())]) if n.props else \
                F.array().cast("array<struct<name:string,value:string>>")
            structs.append(F.when(_present([n.node_id], n.when), F.struct(
                F.lit(n.node_type).alias("node_type"), n.node_id.cast("string").alias("node_id"), facts.alias("facts"))))
        if structs:
            rows = s.rows.select(F.explode(F.array_compact(F.array(*structs))).alias("n")).select("n.*")
            parts = rows if parts is None else parts.unionByName(rows)
    facts = parts.select("node_type", "node_id", F.explode_outer("facts").alias("f")).select("node_type", "node_id", "f.name", "f.value")
    per = facts.groupBy("node_type", "node_id", "name").agg(F.max("value").alias("value"))
    known = F.filter(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value")))), lambda x: x.isNotNull())
    return per.groupBy("node_type", "node_id").agg(F.to_json(F.map_from_entries(known)).alias("props"))


def nodes_from_edges(e: DataFrame) -> DataFrame:
    """JN3: the node set (type, id) touched by the edge table, with degree; both ends of an edge come from one scan."""
    ends = e.select(F.explode(F.array(
        F.struct(F.col("from_type").alias("node_type"), F.col("from_id").alias("node_id"), F.lit(1).alias("out_deg"), F.lit(0).alias("in_deg")),
        F.struct(F.col("to_type").alias("node_type"), F.col("to_id").alias("node_id"), F.lit(0).alias("out_deg"), F.lit(1).alias("in_deg")))).alias("n")).select("n.*")
    return ends.groupBy("node_type", "node_id").agg(F.sum("out_deg").cast("bigint").alias("out_degree"),
                                                    F.sum("in_deg").cast("bigint").alias("in_degree"))


def write_edges(e: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist edges partitioned by type, clustered by source id."""
    (e.repartition("edge_type", "from_id").sortWithinPartitions("from_id")
      .write.mode(mode).partitionBy("edge_type").parquet(path))


@dataclass(frozen=True)
class Part:
    """Child rows of a decision: ``fields`` of each, in the order of ``order`` (the first of them decides)."""
    rows: DataFrame
    fields: Sequence[str]
    order: Sequence[str]
    key: str = "decision_id"


def decision_documents(decisions: DataFrame, parts: Mapping[str, Part], key: str = "decision_id") -> DataFrame:
    """JN4: one nested row per decision: its columns, and for each part an ordered array of structs (empty if none).

    Each part is folded on its own, so a decision's rows meet once and no join multiplies them.
    """
    out = decisions
    for name, p in parts.items():
        folded = p.rows.filter(F.col(p.key).isNotNull()).groupBy(F.col(p.key).alias(key)).agg(
            F.array_sort(F.collect_list(F.struct(F.struct(*p.order).alias("o"), F.struct(*p.fields).alias("v")))).alias(name))
        out = out.join(folded.select(key, F.transform(name, lambda x: x["v"]).alias(name)), key, "left")
    return out.select(*decisions.columns, *[F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n in parts])


#: Folders that the stored documents are dealt to by a hash of the decision.
DOCUMENT_FOLDERS = 64


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(folders)).cast("int")


def write_documents(documents: DataFrame, path: str, key: str = "decision_id", folders: int = DOCUMENT_FOLDERS,
                    tenant_col: str = "tenant_id", mode: str = "overwrite") -> None:
    """Store documents clustered by decision: a folder per tenant and hash of the id, sorted by id inside a file.

    A scoped read then opens one folder, and inside its files only the row groups whose range holds the id.
    """
    rows = documents.withColumn("folder", _folder(F.col(key), folders))
    (rows.repartition(tenant_col, "folder").sortWithinPartitions(tenant_col, "folder", key)
         .write.mode(mode).partitionBy(tenant_col, "folder").parquet(path))


def read_decision(spark: SparkSession, path: str, tenant: str, decision, schema: T.StructType | None = None,
                  key: str = "decision_id", folders: int = DOCUMENT_FOLDERS, tenant_col: str = "tenant_id") -> DataFrame:
    """JN4 scoped: the nested document of one decision of one tenant (no row if it isn't that tenant's).

    With ``schema`` given no file is opened to infer one. The filter names the folder as a literal, so other folders
    are pruned when files are listed, and the id is pushed down to the row groups.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    docs = reader.parquet(path)
    wanted = F.lit(decision).cast(docs.schema[key].dataType)
    return docs.filter((F.col(tenant_col) == F.lit(tenant)) & (F.col("folder") == _folder(wanted, folders)) & (F.col(key) == wanted)).drop("folder")


#: Edges, or frontier rows, of one node that a cell of a walk's join holds on average.
HUB_ROWS = 20_000
#: Hubs that may be broadcast (about 100 bytes a row); more of them are joined like any table.
HUB_BROADCAST_ROWS = 100_000
_NODE = ["node_type", "node_id"]


def hub_parts(rows: DataFrame, kind: str, ident: str, limit: int, out: str) -> DataFrame:
    """Nodes with more than ``limit`` rows, and in ``out`` the number of parts of about ``limit`` rows each. Counts are
    combined map-side, so a hub costs the count no more than other nodes."""
    n = rows.groupBy(F.col(kind).alias("node_type"), F.col(ident).alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") > limit).select(*_NODE, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias(out))


def _part(cols: Sequence[str], parts: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.col(parts)).cast("int")


def split_hubs(frontier: DataFrame, e: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a hop with the cell ``(seed_part, edge_part)`` that each row goes to.

    A hub's frontier rows are dealt to ``seed_parts`` by their seed and its edges to ``edge_parts`` by their end; every
    pair of parts is one cell, so each (seed, edge) pair still meets once. Nodes that ``hubs`` lacks have one cell.
    """
    def sized(df: DataFrame, kind: str, ident: str) -> DataFrame:
        h = hubs.withColumnsRenamed({"node_type": "__t", "node_id": "__i"})
        return df.join(h, (F.col(kind) == F.col("__t")) & (F.col(ident) == F.col("__i")), "left").drop("__t", "__i").withColumns(
            {c: F.coalesce(c, F.lit(1)) for c in ("seed_parts", "edge_parts")})

    f = sized(frontier, "node_type", "node_id").withColumn("seed_part", _part(("seed_type", "seed_id"), "seed_parts")).withColumn(
        "edge_part", F.explode(F.sequence(F.lit(0), F.col("edge_parts") - 1)))
    g = sized(e, "from_type", "from_id").withColumn("edge_part", _part(("to_type", "to_id"), "edge_parts")).withColumn(
        "seed_part", F.explode(F.sequence(F.lit(0), F.col("seed_parts") - 1)))
    return f.drop("seed_parts", "edge_parts"), g.drop("seed_parts", "edge_parts")


def _hop(frontier: DataFrame, e: DataFrame, edge_hubs: DataFrame, limit: int) -> DataFrame:
    """Frontier rows joined with the edges of their nodes, hubs split by their counts on both sides."""
    hubs = cut_lineage(edge_hubs.join(hub_parts(frontier, "node_type", "node_id", limit, "seed_parts"), _NODE, "full"))
    n = hubs.count()
    on = (F.col("node_type") == F.col("from_type")) & (F.col("node_id") == F.col("from_id"))
    if n == 0:
        return frontier.join(e, on)
    f, g = split_hubs(frontier, e, F.broadcast(hubs) if n <= HUB_BROADCAST_ROWS else hubs)
    g = g.withColumnsRenamed({"seed_part": "__sp", "edge_part": "__ep"})
    return f.join(g, on & (F.col("seed_part") == F.col("__sp")) & (F.col("edge_part") == F.col("__ep")))


def walk(e: DataFrame, seeds: DataFrame, max_hops: int, follow: Sequence[str] | None = None,
         checkpoint_every: int = 1, hub_rows: int = HUB_ROWS) -> DataFrame:
    """JN6: nodes reachable from each seed in at most ``max_hops`` forward hops.

    ``seeds`` has ``(seed_type, seed_id)``. Each hop is an equi-join of the
    frontier with the edges on the source node, then an anti join against
    what was already reached, so every (seed, node) pair is expanded once,
    at its minimum hop count. Parallel edges count as one and are stored once
    for all hops. A node with more than ``hub_rows`` edges, or that more than
    ``hub_rows`` seeds have reached, is split into cells by its counts, so a
    task's share of it is bounded whatever its degree. Lineage is cut with a
    reliable checkpoint after each hop so a lost executor does not replay the
    whole walk. Rows with a null end lead nowhere; no seeds or no edges give
    no rows.
    """
    if follow:
        e = e.filter(F.col("edge_type").isin(list(follow)))
    e = cut_lineage(e.select("from_type", "from_id", "to_type", "to_id").dropna().distinct())
    edge_hubs = hub_parts(e, "from_type", "from_id", hub_rows, "edge_parts")
    start = seeds.select("seed_type", "seed_id", F.col("seed_type").alias("node_type"),
                         F.col("seed_id").alias("node_id"), F.lit(0).alias("hops")).distinct()
    reached = start
    frontier = start
    for hop in range(1, max_hops + 1):
        nxt = (_hop(frontier, e, edge_hubs, hub_rows)
               .select("seed_type", "seed_id", F.col("to_type").alias("node_type"), F.col("to_id").alias("node_id"))
               .distinct()
               .join(reached.select("seed_type", "seed_id", "node_type", "node_id"),
                     ["seed_type", "seed_id", "node_type", "node_id"], "left_anti")
               .withColumn("hops", F.lit(hop)))
        if checkpoint_every and hop % checkpoint_every == 0:
            nxt = cut_lineage(nxt)
        reached = reached.unionByName(nxt)
        frontier = nxt
    return reached.filter(F.col("hops") > 0)


def erase_user(content: DataFrame, requests: DataFrame, user_col: str = "user_id",
               content_cols: Sequence[str] = ("internal_note",)) -> DataFrame:
    """JN11: remove content of erased users, keep structure, flag the rows.

    ``requests`` holds the users to erase. Structural columns are kept;
    content columns are nulled and ``content_deleted`` set. Spark broadcasts
    a small request list and shuffles both sides otherwise.
    """
    req = requests.select(F.col(user_col).alias("__erase")).distinct()
    j = content.join(req, content[user_col] == F.col("__erase"), "left")
    deleted = F.col("__erase").isNotNull()
    out = j.select(*[F.when(deleted, F.lit(None).cast(content.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                     if c in content_cols else F.col(c) for c in content.columns],
                   deleted.alias("content_deleted"))
    return out


def deletion_events(erased: DataFrame, id_col: str, at: str) -> DataFrame:
    """JN11: one ``content_deleted`` event per flagged node."""
    return erased.filter("content_deleted").select(
        F.col(id_col).cast("string").alias("node_id"), F.lit("content_deleted").alias("event"),
        F.lit(at).cast("timestamp_ntz").alias("ts"))


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


#: Queries that one block's row holds.
QUERIES_PER_BLOCK = 256


def similarity_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
                     vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "query_vec",
                     blocks: int | None = None, buckets: int = 512) -> DataFrame:
    """JN13: the ``k`` most cosine-similar vectors to each query vector.

    The query set is stated by the caller and compared with all vectors, in
    blocks: a count of the queries gives as many blocks as hold about
    QUERIES_PER_BLOCK each (``blocks`` sets it), queries are dealt by a hash and
    gathered into one row per block, each vector row is sent to every block by
    an equi-join on the block number, and scores a block's queries in one
    array expression. Norms are computed once per vector and per query. The top
    ``k`` per query uses the two-level salted top-k, ties broken by id.
    Similarity is computed in DOUBLE and rounded to 6 places; a vector of
    length zero has none and is no result.
    """
    if blocks is None:
        blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    q = queries.select(qid_col, F.col(qvec_col).alias("__qv"), _norm(qvec_col).alias("__qn")).filter("__qn > 0")
    q = (q.withColumn("__b", F.pmod(F.xxhash64(qid_col), F.lit(blocks)).cast("int")).groupBy("__b")
          .agg(F.collect_list(F.struct(F.col(qid_col).alias("qid"), F.col("__qv").alias("qv"),
                                       F.col("__qn").alias("qn"))).alias("__qs")))
    number = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
    v = vectors.select(id_col, F.col(vec_col).alias("__v"), _norm(vec_col).alias("__n"), number.alias("__b")).filter("__n > 0")
    scored = v.join(q, "__b").select(id_col, F.explode(F.transform("__qs", lambda x: F.struct(
        x["qid"].alias("qid"), F.round(_dot(x["qv"], F.col("__v")) / (x["qn"] * F.col("__n")), 6).alias("sim")))).alias("s"))
    scored = scored.select(F.col("s.qid").alias(qid_col), id_col, F.col("s.sim").alias("similarity"))
    return top_k(scored, [qid_col], [F.col("similarity").desc(), F.col(id_col).asc()], k, id_col,
                 buckets=buckets)


@dataclass(frozen=True)
class HyperplaneIndex:
    """Cosine LSH: ``tables`` hashes of ``bits`` random hyperplanes each, drawn from ``seed``.

    A vector's bucket in a table is the side of each hyperplane it lies on. A query also looks into the buckets that
    differ in its ``probes`` least certain sides, one at a time and in pairs. Two vectors at an angle a share a side with
    probability 1 - a / pi, so more bits make buckets smaller and more tables or probes find more.
    """
    dim: int
    tables: int = 24
    bits: int = 8
    probes: int = 4
    seed: int = 71

    def sized(self, rows: int, bucket: int = 256) -> HyperplaneIndex:
        """The same index with as many bits as make ``rows`` vectors about ``bucket`` a bucket."""
        return replace(self, bits=max(1, round(math.log2(max(rows, 2) / bucket))))


#: Rows of a bucket, and queries that look into one, that a cell of the search holds on average.
CELL_ROWS, CELL_QUERIES = 20_000, 2_000


def _celled(rows: DataFrame, index: HyperplaneIndex, vec_col: str, probe: bool = False) -> DataFrame:
    """``rows``, whose vectors all have the index's length, with ``cells``: table * 2 ** bits + bucket of each table, or with
    ``probe`` of all buckets to look into. Arrow batches, one matrix product each."""
    dim, tables, bits = index.dim, index.tables, index.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(index.seed).normal(size=(dim, tables * bits))
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            x = batch.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            side = (x @ planes).reshape(len(x), tables, bits)
            codes = ((side > 0) @ powers)[:, :, None]
            if probe:
                weak = np.argsort(np.abs(side), axis=2)[:, :, :min(index.probes, bits)]
                flips = powers[weak]
                one = np.concatenate([np.zeros((*codes.shape[:2], 1), np.int64), flips], axis=2)
                pairs = [flips[:, :, i] ^ flips[:, :, j] for i in range(flips.shape[2]) for j in range(i)]
                codes = codes ^ np.concatenate([one, *[p[:, :, None] for p in pairs]], axis=2)
            cells = codes + (np.arange(tables, dtype=np.int64) << bits)[:, None]
            each = tables * codes.shape[2]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * each + 1, each, dtype=np.int32)), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))]))


def lsh_buckets(df: DataFrame, index: HyperplaneIndex, id_col: str, vec_col: str, probe: bool = False) -> DataFrame:
    """``id, table, bucket`` of each vector: its own bucket in each table, or with ``probe`` all it should look into.

    Null vectors and vectors of another length have no bucket.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") == index.dim)
    cells = _celled(rows, index, "v", probe).select("id", F.explode("cells").alias("cell"))
    return cells.select("id", F.shiftright("cell", index.bits).cast("int").alias("table"), F.col("cell").bitwiseAND((1 << index.bits) - 1).alias("bucket"))


def _rounded(sims: np.ndarray) -> np.ndarray:
    """Similarities rounded to 6 places, halves away from zero by their shortest decimal form, as Spark's ``round`` does;
    2 for NaN, which Spark sorts above all numbers."""
    far = np.abs(sims) * 1e6
    out = np.copysign(np.floor(far + 0.5) / 1e6, sims) + 0.0
    for i in np.flatnonzero(np.abs(far - np.floor(far) - 0.5) < 1e-4).tolist():
        out[i] = float(Decimal(repr(float(sims[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return np.where(np.isnan(sims), 2.0, out)


class _CellSearch:
    """Queries of one cell and their best ``k`` rows so far; rows come in the order of their ids, so of equal ones the first stays."""
    def __init__(self, batch: pa.RecordBatch, k: int, dim: int):
        self.batch, self.k, self.dim = batch, k, dim
        self.x, self.norms = self._matrix(batch), batch.column("norm").to_numpy()
        self.q, self.key, self.sim = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.rows = {c: np.zeros(0, object) for c in ("id", "n", "hash")}
        self.bar = np.full(batch.num_rows, -np.inf)

    def _matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.dim)

    def see(self, batch: pa.RecordBatch) -> None:
        x, norms = self._matrix(batch), batch.column("norm").to_numpy()
        with np.errstate(all="ignore"):
            near = (self.x @ x.T) / (self.norms[:, None] * norms)
            near[np.isnan(near)] = 2.0
            low = self.bar
            if len(x) > self.k:
                low = np.maximum(low, np.partition(near, len(x) - self.k, axis=1)[:, len(x) - self.k])
            qi, vi = np.nonzero(near >= low[:, None] - 2e-6)        # what may be among the best once rounded
            sims = np.zeros(len(qi))
            for a, b in zip(self.x.T, x.T, strict=True):            # summed in the order of the entries, as the exact path does
                sims += a[qi] * b[vi]
            sims /= self.norms[qi] * norms[vi]
        q, key, sim = np.concatenate([self.q, qi]), np.concatenate([self.key, _rounded(sims)]), np.concatenate([self.sim, sims])
        by = np.lexsort((np.arange(len(q)), -key, q))
        first = np.searchsorted(q[by], q[by])
        by = by[np.arange(len(by)) - first < self.k]
        old, new = by[by < len(self.q)], by[by >= len(self.q)] - len(self.q)
        place = np.argsort(np.argsort(by >= len(self.q), kind="stable"), kind="stable")
        for c, held in self.rows.items():
            come = np.array([*batch.column(c).take(pa.array(vi[new])).to_pylist(), None], object)[:-1]
            self.rows[c] = np.concatenate([held[old], come])[place]
        self.q, self.key, self.sim = q[by], key[by], sim[by]
        full = np.flatnonzero(np.bincount(self.q, minlength=len(self.bar)) == self.k)
        self.bar[full] = self.key[np.searchsorted(self.q, full, side="right") - 1]

    def give(self, schema: pa.Schema) -> pa.RecordBatch:
        at = pa.array(self.q)
        cols = [self.batch.column("qid").take(at), self.batch.column("hash").take(at), *(self.rows[c].tolist() for c in ("id", "hash", "n")), self.sim]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _cell_search(have: DataFrame, ask: DataFrame, k: int, dim: int) -> DataFrame:
    """``qid, qhash, id, hash, n, sim``: each query's best ``k`` of each cell. A cell's queries are held in its task, its rows
    stream by."""
    names = ["cell", "part", "kind", "qid", "id", "hash", "n", "norm", "vec"]
    both = ask.withColumn("kind", F.lit(0)).unionByName(have.withColumn("kind", F.lit(1)), allowMissingColumns=True).select(*names)
    schema = T.StructType([both.schema["qid"], T.StructField("qhash", T.LongType()), both.schema["id"], T.StructField("hash", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, state, out = None, [], None, None
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                out = out or pa.schema([("qid", batch.schema.field("qid").type), ("qhash", pa.int64()), ("id", batch.schema.field("id").type),
                                        ("hash", pa.int64()), ("n", pa.int64()), ("sim", pa.float64())])
                cell, part, kind = (batch.column(c).to_numpy() for c in ("cell", "part", "kind"))
                at = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
                for i, j in zip(at.tolist(), [*at[1:].tolist(), len(cell)], strict=True):
                    if (cell[i], part[i]) != now:
                        if state is not None:
                            yield state.give(out)
                        now, waiting, state = (cell[i], part[i]), [], None
                    if kind[i] == 0:
                        waiting.append(batch.slice(i, j - i))
                        continue
                    if state is None and waiting:
                        state = _CellSearch(pa.concat_batches(waiting), k, dim)
                    if state is not None:
                        state.see(batch.slice(i, j - i))
        if state is not None:
            yield state.give(out)

    by = ["cell", "part"]
    return both.repartition(*by).sortWithinPartitions(*by, "kind", "id").mapInArrow(run, schema)


def similarity_lsh(vectors: DataFrame, queries: DataFrame, k: int, index: HyperplaneIndex, id_col: str = "vec_id",
                   vec_col: str = "embedding", qid_col: str = "query_id", qvec_col: str = "query_vec",
                   buckets: int = 64) -> DataFrame:
    """JN13 for sets too large to compare: candidates from the index, then the exact similarity and top ``k``.

    Vectors go once to their bucket of each table, queries to the buckets they look into; a bucket's task scores all its
    pairs in matrix products and gives the best ``k`` of each query. No pair is written, so what is shuffled grows with
    the vectors. Every vector is indexed. Buckets of a dense region are split by counts into cells of about CELL_ROWS rows and
    CELL_QUERIES queries that meet pairwise; of equal vectors the rows with the ``k`` smallest ids go, and equal queries are
    asked once. Columns, rounding and ties are those of :func:`similarity_top_k`, to which the recall is measured.
    """
    single = all(df.schema[c].dataType.elementType.simpleString() == "float" for df, c in ((vectors, vec_col), (queries, qvec_col)))
    kind = f"array<{'float' if single else 'double'}>"

    def rows(df: DataFrame, ident: str, vec: str, name: str) -> DataFrame:
        """Different ``name, vec`` rows whose vector has a direction, and how often each is there."""
        r = df.select(F.col(ident).alias(name), F.col(vec).cast(kind).alias("vec")).filter(F.col(name).isNotNull() & (F.size("vec") == index.dim))
        r = r.groupBy(name, "vec").agg(F.count(F.lit(1)).alias("n")).withColumns({"norm": _norm("vec"), "hash": F.xxhash64("vec")})
        return r.filter("norm > 0")

    v = top_k(rows(vectors, id_col, vec_col, "id"), ["vec"], [F.col("id").asc()], k, "id", buckets=buckets).select("id", "vec", "n", "norm", "hash")
    members = rows(queries, qid_col, qvec_col, "qid")
    asked = members.groupBy("vec", "norm", "hash").agg(F.min("qid").alias("qid"))
    have = _celled(v, index, "vec").select(F.explode("cells").alias("cell"), "id", "vec", "n", "norm", "hash")
    ask = _celled(asked, index, "vec", probe=True).select(F.explode("cells").alias("cell"), "qid", "vec", "norm", "hash")

    # cells of the few buckets that hold more than a task should
    count = lambda df, name: df.groupBy("cell").agg(F.count(F.lit(1)).alias(name))
    sizes = count(have, "v").join(count(ask, "q"), "cell").filter((F.col("v") > CELL_ROWS) | (F.col("q") > CELL_QUERIES))
    large = F.broadcast(cut_lineage(sizes.select(F.col("cell").alias("__cell"), F.ceil(F.col("v") / CELL_ROWS).cast("int").alias("__vs"),
                                                 F.ceil(F.col("q") / CELL_QUERIES).cast("int").alias("__qs"))))

    def parted(df: DataFrame, own: str, other: str, part: Callable[[Column, Column], Column], key: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key, "hash"), F.coalesce(own, F.lit(1)))
        split = df.join(large, F.col("cell") == F.col("__cell"), "left").withColumn("__other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return split.withColumn("part", part(mine, F.col("__other")).cast("bigint")).drop("__cell", "__vs", "__qs", "__other")

    qs = F.coalesce("__qs", F.lit(1))
    found = _cell_search(parted(have, "__vs", "__qs", lambda a, b: a * qs + b, "id"), parted(ask, "__qs", "__vs", lambda a, b: b * qs + a, "qid"), k, index.dim)
    reps = F.min("qid").over(Window.partitionBy("vec")).alias("rep")
    who = members.select("qid", "n", F.col("hash").alias("qhash"), reps).withColumnsRenamed({"qid": "__qid", "n": "__n"})
    named = found.distinct().withColumnRenamed("qid", "rep").join(who, ["rep", "qhash"])
    copies = F.explode(F.array_repeat(F.lit(0), F.least(F.col("n") * F.col("__n"), F.lit(k)).cast("int"))).alias("__copy")
    scored = named.select(F.col("__qid").alias(qid_col), F.col("id").alias(id_col), F.round("sim", 6).alias("similarity"), copies).drop("__copy")
    return top_k(scored, [qid_col], [F.col("similarity").desc(), F.col(id_col).asc()], k, id_col, buckets=buckets)


def search_recall(found: DataFrame, exact: DataFrame, qid_col: str = "query_id") -> DataFrame:
    """One row: queries, exact results, how many were found (as good a similarity counts), and their share."""
    worst = exact.groupBy(qid_col).agg(F.min("similarity").alias("__least"), F.count(F.lit(1)).alias("__n"))
    hits = found.join(worst.select(qid_col, "__least"), qid_col).filter("similarity >= __least").groupBy(qid_col).agg(F.count(F.lit(1)).alias("__hit"))
    return worst.join(hits, qid_col, "left").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("__n").alias("results"), F.coalesce(F.sum("__hit"), F.lit(0)).alias("found"),
        (F.coalesce(F.sum("__hit"), F.lit(0)) / F.sum("__n")).alias("recall"))


def centroids(vectors: DataFrame, group_col: str, vec_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Mean vector per group (element-wise), computed as a grouped sum of
    positions: ``(group, pos) -> avg``; then reassembled in position order."""
    pe = vectors.select(group_col, F.posexplode(vec_col).alias("pos", "x"))
    per = pe.groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def same_content_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """AG13: content hashes shared by more than one decision."""
    h = df.select(id_col, F.sha2(F.col(text_col), 256).alias("content_hash"))
    return (h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_decisions"), F.min(id_col).alias("first_id"),
                                         F.max(id_col).alias("last_id"))
             .filter(F.col("n_decisions") > 1))

