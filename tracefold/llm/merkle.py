"""Operator 12: a Merkle manifest of a table, with a proof for every row and the check of (changed) rows against it.

Every row is a leaf. The leaves of a group, in order, are the bottom of a binary tree whose last node of a level may
have a single child; the groups' roots, in order, are the bottom of one more tree, whose root stands for the table.
A digest is the lower-case hex SHA-256 of the concatenated hex digests (or, for a leaf, of its encoded fields).

Method: time-forward processing. A node's label is its place in the order in which digests are computed (by level,
then from left to right); each node sends its digest to the queue under its parent's label, and a parent takes from
the queue what its children sent. A reversed sweep, from the last label to the first, hands each node the proof
suffix of its parent and its sibling's digest, until every leaf has its own. The external part of the queue is
Spark's: trees are cut into slabs of LEVELS levels and slabs into blocks of 2**LEVELS neighbours, and a shuffle sorted by
(tree, block, position) brings what a block's nodes were sent. Inside a block a heap of at most 2**LEVELS messages is
the queue. So a tree of n leaves takes log(n) / LEVELS shuffles of digests each way, and no task holds more than a block
however large its tree is.

Defined results: a null field is encoded as ``-``; leaves of a group ascend by key (null first), equal keys by their
digests, so repeated rows are leaves of their own; the null group comes first. An empty table gives no rows. Texts
of any length are hashed by Spark and travel no further. Columns that aren't named are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracefold.llm.common import ranked, slices, written

#: Levels of a tree that one shuffle covers.
LEVELS = 11
LEFT, RIGHT, ALONE = "L", "R", "="


def sha256(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(c: Column) -> Column:
    """A field as bytes: ``-`` if null, else the number of its UTF-8 bytes, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c).cast("binary") for c in fields]), 256)


def tree_name(group: Column) -> Column:
    """A group's value as a name without nulls, in the same order: the null group first, the others bytewise."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


# --------------------------------------------------------------------------- one block
def levels_of(nodes: int, size: int, height: int) -> int:
    """Levels above a block of ``nodes``, of ``size`` in the tree: up to a single one if the block is all of them."""
    return (nodes - 1).bit_length() if size <= 1 << height else height


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """All levels above a block's nodes, bottom first: each node sends its digest ahead to its parent's label."""
    out = [digests]
    widths = [len(digests)]
    for _ in range(levels):
        widths.append((widths[-1] + 1) // 2)
    first = [sum(widths[:k]) for k in range(levels + 2)]           # label of each level's first node
    queue = [(first[1] + i // 2, i, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    for level in range(1, levels + 1):
        done: list[str] = []
        for label in range(first[level], first[level + 1]):
            sent = []
            while queue and queue[0][0] == label:
                sent.append(heapq.heappop(queue)[2])
            digest = sha256(*sent)
            if level < levels:
                heapq.heappush(queue, (first[level + 1] + len(done) // 2, label, digest))
            done.append(digest)
        out.append(done)
    return out


def reverse(levels: list[list[str]], suffix: list[str]) -> list[list[str]]:
    """Proof of each bottom node: from the top label down, a node hands its own proof and the sibling to its children."""
    proofs = [suffix]
    for below in reversed(levels[:-1]):
        handed = []
        for i in range(len(below)):
            step = LEFT + below[i - 1] if i % 2 else RIGHT + below[i + 1] if i + 1 < len(below) else ALONE
            handed.append([step, *proofs[i // 2]])
        proofs = handed
    return proofs


def fold(digest: str, proof: list[str]) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for step in proof:
        side, other = step[0], step[1:]
        digest = sha256(other, digest) if side == LEFT else sha256(digest, other)
    return digest


def siblings(proof: list[str]) -> str:
    """SHA-256 of a proof's sibling digests, leaf to root."""
    return sha256(*[step[1:] for step in proof])


# --------------------------------------------------------------------------- trees over Spark
@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, pos, size, key, digest and the carried columns; ``slabs``: the bottom nodes of each slab, then a row
    for each tree; ``subroots``: tree, digest and the proof that leads from it to the ``root``."""
    leaves: DataFrame
    slabs: list[DataFrame]
    subroots: DataFrame
    root: str | None
    height: int


def _by_block(rows: DataFrame, f: Callable, schema: str, extra: list[Column] | None = None) -> DataFrame:
    by = [F.col("tree"), F.col("block")]
    return rows.repartition(*by).sortWithinPartitions(*by, *(extra or []), F.col("pos")).mapInArrow(f, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (tree, block) after another; 2**LEVELS and one at most."""
    run: list[dict] = []
    for batch in slices(batches, 2048):
        for row in batch.to_pylist():
            if run and (row["tree"], row["block"]) != (run[-1]["tree"], run[-1]["block"]):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _slab_up(nodes: DataFrame, height: int) -> DataFrame:
    """The top node of each block: ``tree, pos, size, digest`` of the next slab."""
    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in _runs(batches):
            size = run[0]["size"]
            top = forward([r["digest"] for r in run], levels_of(len(run), size, height))[-1]
            out.append({"tree": run[0]["tree"], "pos": run[0]["block"], "size": -(-size >> height), "digest": top[0]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())]))

    blocks = nodes.select("tree", "pos", "size", "digest", F.shiftright("pos", height).alias("block"))
    return _by_block(blocks, up, "tree string, pos bigint, size bigint, digest string")


def slabs(leaves: DataFrame, most: int, height: int) -> list[DataFrame]:
    """Bottom nodes of each slab, bottom slab first, and at the end one row for each tree; ``most``: its largest size."""
    out = [leaves.select("tree", "pos", "size", "digest")]
    while True:
        out.append(written(_slab_up(out[-1], height), "merkle-slab"))
        most = -(-most >> height)
        if most <= 1:
            return out


def _slab_down(nodes: DataFrame, above: DataFrame, height: int, carried: str, last: Callable[[dict, list[str]], dict] | None, schema: str,
               fields: list[str]) -> DataFrame:
    """Proofs of a slab's bottom nodes from those of the slab above (``tree, pos, proof`` and ``carried``)."""
    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for run in _runs(batches):
            head, rest = run[0], run[1:]
            size = rest[0]["size"]
            known = forward([r["digest"] for r in rest], levels_of(len(rest), size, height))
            for row, proof in zip(rest, reverse(known, head["proof"]), strict=True):
                row = {**row, carried: head[carried], "proof": proof}
                out.append({k: v for k, v in (last(row) if last else row).items() if k in fields})
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)
    below = nodes.withColumn("block", F.shiftright("pos", height)).withColumn("kind", F.lit(1))
    heads = above.select("tree", F.col("pos").alias("block"), "proof", carried, F.lit(0).alias("kind"))
    return _by_block(below.unionByName(heads, allowMissingColumns=True), down, schema, [F.col("kind")])


def build(df: DataFrame, fields: list[str], group: str, key: str, carry: dict[str, Column] | None = None,
          height: int = LEVELS) -> Manifest:
    """Leaves in order, the groups' subroots with their proofs to the root (``tree, digest, proof``), and the root.

    ``carry`` names columns to keep with the leaves (computed from the row).
    """
    rows = df.select(tree_name(F.col(group)).alias("tree"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
                     *[c.alias(n) for n, c in (carry or {}).items()])
    order = [F.col("key").asc_nulls_first(), F.col("digest")]
    leaves = written(ranked(rows, order, "merkle-order"), "merkle-leaves")
    most = leaves.agg(F.max("size")).first()[0]
    if most is None:
        return Manifest(leaves, [], leaves.select("tree", "digest", F.array().cast("array<string>").alias("proof")), None, height)
    own = slabs(leaves, most, height)
    tops = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = written(ranked(tops, [F.col("name")], "merkle-order"), "merkle-tops")
    n = tops.agg(F.max("size")).first()[0]
    over = slabs(tops, n, height)
    root = over[-1].first()["digest"]
    proofs = over[-1].select("tree", "pos", F.array().cast("array<string>").alias("proof"), F.lit("").alias("none"))
    kinds = "tree string, pos bigint, proof array<string>, none string"
    for nodes in over[-2:0:-1]:
        proofs = _slab_down(nodes, proofs, height, "none", None, kinds, ["tree", "pos", "proof", "none"])
    proofs = _slab_down(tops, proofs, height, "none", None, "name string, digest string, proof array<string>", ["name", "digest", "proof"])
    return Manifest(leaves, own, written(proofs.select(F.col("name").alias("tree"), "digest", "proof"), "merkle-subroots"), root, height)


def proofs(manifest: Manifest, last: Callable[[dict], dict] | None = None, schema: str | None = None) -> DataFrame:
    """Each leaf with ``subroot`` and ``proof`` (steps ``L``/``R`` with the sibling's digest on that side, ``=`` for none).

    ``last`` turns such a row into the one to return, inside the task that made it, so that long proofs need not
    be written out; ``schema`` then names its columns.
    """
    leaves = manifest.leaves
    spark = leaves.sparkSession
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema.fields)
    schema = schema or f"{own}, subroot string, proof array<string>"
    names = spark.createDataFrame([], schema).columns
    if manifest.root is None:
        return spark.createDataFrame([], schema)
    above = manifest.subroots.select("tree", F.lit(0).cast("bigint").alias("pos"), "proof", F.col("digest").alias("subroot"))
    for nodes in manifest.slabs[-2:0:-1]:
        above = _slab_down(nodes, above, manifest.height, "subroot", None, "tree string, pos bigint, proof array<string>, subroot string", ["tree", "pos", "proof", "subroot"])
    return _slab_down(leaves, above, manifest.height, "subroot", last, schema, names)


def verify(df: DataFrame, fields: list[str], group: str, key: str, changed: dict[str, Column], height: int = LEVELS) -> DataFrame:
    """Build the manifest of ``df``, then hold every row, with the ``changed`` columns in place, against its proof.

    Returns ``key, leaf, subroot, root, proof_sha256, folded_root, verified``: ``folded_root`` is what the changed
    row's leaf and the original siblings lead to, ``verified`` says whether it is the root.
    """
    changed_leaf = leaf_digest([changed.get(c, F.col(c)) for c in fields])
    manifest = build(df, fields, group, key, {"seen": changed_leaf}, height)
    root = manifest.root

    def check(row: dict) -> dict:
        folded = fold(row["seen"], row["proof"])
        return {"key": row["key"], "leaf": row["digest"], "subroot": row["subroot"], "root": root, "proof_sha256": siblings(row["proof"]),
                "folded_root": folded, "verified": folded == root}

    kind = manifest.leaves.schema["key"].dataType.simpleString()
    return proofs(manifest, check, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
