"""Operator 7: near-duplicate documents.

Method: SuperMinHash signatures (each shingle brings a random permutation of the signature's places, of which
only as much is drawn as can still lower a value), banding, verification on the full shingle sets, and
union-find grouping.

1. One pass over the texts gives each document its set size, a 128-bit fingerprint of its shingle set, and its
   band keys. Documents with equal sets form a class; only one of them goes on.
2. Members of a band bucket are paired with the bucket's smallest member, and each keeps the two partners it
   shares most buckets with. Verified pairs become links; links become groups.
3. Where a bucket still holds several groups, its members are joined exactly: two sets with a similarity at the
   threshold share one of their rarest shingles (prefix filter), so members of different groups that do are
   verified as well. So no bucket is paired off in full, whatever its size, and no link is lost that any bucket saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import slices, written
from tracefold.llm.components import components
from tracefold.operators.ordering import join_split

WORDS = 5
#: 32 bands of 6 places: a pair with a similarity of 0.85 misses all buckets with a probability of 3e-7, one of 0.80
#: with 6e-5.
BANDS, PLACES = 32, 6
#: Hash classes in which two sets' shingles are counted to bound what they can share.
SPREAD = 128
#: Rows of equal sets that a task takes; larger classes are split.
CLASS_ROWS = 100_000
#: Link if PERCENT of the union is shared.
PERCENT = 85
SEED = 0x5EED
_EMPTY = np.int64(2**63 - 1)
_WORD_CACHE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: bytes | None, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, sorted: every run of ``words`` words, with A-Z in lower case; the
    whole sequence if it is shorter; nothing without words."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(known.__getitem__, w)), np.uint64)
    k = min(words, len(h))
    x = h[: len(h) - k + 1]
    for i in range(1, k):
        x = mix(x) + h[i: len(h) - k + 1 + i]
    return np.unique(mix(x + np.uint64(k)))


def superminhash(sets: list[np.ndarray], places: int, seed: int = SEED) -> np.ndarray:
    """Signatures (sets x places) of non-empty sets of hashes.

    Shingle e draws a permutation of the places step by step (Fisher-Yates) and a fraction for each step; place
    p gets the least of step + fraction over all shingles that reach p in that step. A set whose places are all
    taken after a step is done, as later steps bring larger values only. All sets take a step together.
    """
    n = len(sets)
    sig = np.full(n * places, _EMPTY, np.int64)
    e = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    drawn: list[np.ndarray] = []        # of the shingles still at work: the place drawn in each step so far
    table: np.ndarray | None = None     # their permutations in full, once few are left
    for step in range(places):
        r = mix(e ^ mix(np.array([seed + step], np.uint64)))
        k = step + ((r >> np.uint64(32)) * np.uint64(places - step) >> np.uint64(32)).astype(np.int64)
        value = (np.int64(step) << np.int64(32)) | (r & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if step == 8:
            table = np.tile(np.arange(places, dtype=np.int16), (len(e), 1))
            lines = np.arange(len(e))
            for i, q in enumerate(drawn):
                table[lines, i], table[lines, q] = table[lines, q].copy(), table[lines, i].copy()
        if table is None:
            p = k
            for i in range(step - 1, -1, -1):       # what stands at k after the swaps so far
                p = np.where(drawn[i] == p, i, p)
            drawn.append(k)
        else:
            lines = np.arange(len(e))
            p = table[lines, k].astype(np.int64)
            table[lines, k], table[lines, step] = table[lines, step].copy(), p
        np.minimum.at(sig, owner * places + p, value)
        open_sets = (sig.reshape(n, places) == _EMPTY).any(axis=1)
        if not open_sets.any():
            break
        at_work = open_sets[owner]
        if not at_work.all():
            e, owner = e[at_work], owner[at_work]
            drawn = [d[at_work] for d in drawn] if table is None else []
            table = table[at_work] if table is not None else None
    return sig.reshape(n, places)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band (sets x bands), different bands having different keys."""
    n, places = sig.shape
    parts = sig.astype(np.uint64).reshape(n, bands, places // bands)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (n, bands)).copy()
    for i in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, i])
    return key.astype(np.int64)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, f1, f2, keys`` for each row: set size, fingerprint of the set, band keys (none if empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 512):
            sets = [shingle_hashes(t, known) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            keys = np.zeros((0, BANDS), np.int64)
            at = 0
            while at < len(full):       # a bounded number of shingles at a time
                end, total = at, 0
                while end < len(full) and (end == at or total + len(full[end]) <= 1_000_000):
                    total += len(full[end])
                    end += 1
                keys = np.concatenate([keys, band_keys(superminhash(full[at:end], BANDS * PLACES))])
                at = end
            sizes = np.array([BANDS if len(s) else 0 for s in sets], np.int32)
            f1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            f2 = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5))).astype(np.int64)) if len(s) else 0 for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists],
                                             names=["doc_id", "n", "f1", "f2", "keys"])

    return (docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``node, shingles, spread``: the full sets of the wanted nodes, from their texts, and how many of a set's
    shingles fall into each of ``SPREAD`` hash classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 512):
            sets = [shingle_hashes(t, known).astype(np.int64) for t in batch.column("text").to_pylist()]
            at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            spread = [np.bincount(s % SPREAD, minlength=SPREAD).astype(np.int32) for s in sets]
            flat = pa.array(np.concatenate(spread) if spread else np.zeros(0, np.int32))
            spreads = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SPREAD), flat)
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, spreads], names=["node", "shingles", "spread"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).cast("binary").alias("text"))
    return rows.join(wanted.hint("shuffle_hash"), "node", "left_semi").mapInArrow(run, "node bigint, shingles array<bigint>, spread array<int>")


def alike(a: str, b: str, percent: int) -> F.Column:
    """Sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    rows = pairs.select("u", "v").join(left, "u").join(right, "v")
    return rows.filter(100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    class_rows: int = CLASS_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of five-word shingles. A
    component's id is the smallest document id in it; the row with that id is kept. Null and empty texts and
    texts without words have an empty set and are linked with nothing. Rows that share an id are one document.
    Rows without an id are linked with nothing, have no component and are kept. An empty table gives an empty
    result. Other columns are not read. A class of more than ``class_rows`` equal sets is dealt to several tasks.
    """
    sig = written(signatures(docs, doc_id, text), "signatures")
    classes = sig.filter("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    rows = join_split(sig.select("doc_id", "n", "f1", "f2"), classes, ["f1", "f2"], hot_rows=class_rows)
    rows = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    member = written(rows, "classes")
    nodes = sig.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi")
    keyed = nodes.select(F.col("doc_id").alias("node"), "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("head")).filter("size > 1")
    placed = written(keyed.join(buckets, "key").select("node", "n", "key", "head"), "buckets")

    sizes = placed.select("node", "n").distinct()
    sets = written(shingle_sets(docs.filter(F.col(doc_id).isNotNull()), sizes.select("node"), doc_id, text), "shingle-sets")
    heads = sizes.select(F.col("node").alias("head"), F.col("n").alias("nh"))
    to_heads = (placed.filter("node <> head").groupBy("node", "n", "head").agg(F.count("*").alias("shared"))
                .join(heads, "head").filter(alike("n", "nh", percent)))
    nearest = Window.partitionBy("node").orderBy(F.desc("shared"), "head")
    pairs = to_heads.withColumn("place", F.row_number().over(nearest)).filter("place <= 2").select(F.col("node").alias("u"), F.col("head").alias("v"))
    links = written(verified(pairs, sets, percent), "pairs")
    found = components(links)

    grouped = placed.join(found, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    several = grouped.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("key")
    left_over = written(grouped.join(several, "key", "left_semi").select("node", "n", "c").distinct(), "several-groups")
    more = written(verified(prefix_pairs(left_over, sets, percent), sets, percent), "pairs")
    final = components(links.unionByName(more))
    return (member.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes (``node, n, c``) of different groups ``c`` that may reach the threshold; none that
    does is left out.

    Only shingles that several groups have can link groups. A set of n needs ceil(percent * n / 100) of them
    in common with any partner, so if it has m in all, one of its m - that + 1 rarest is shared and, as all
    sets follow the same order (document frequency among these nodes, then hash), it is among the partner's
    rarest as well. Of the pairs that meet so, those stay whose places in the two orders, and whose shingles
    counted by hash class, leave room for the overlap that they need.
    """
    each = nodes.join(sets.select("node", "shingles"), "node").select("node", "c", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df"), F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("s", "df")
    shared = each.join(often, "s")
    by_node = Window.partitionBy("node")
    placed = shared.select("node", "s", F.row_number().over(by_node.orderBy("df", "s")).alias("i"), F.count("*").over(by_node).alias("m"))
    need = F.floor((F.col("n") * percent + 99) / 100)
    prefix = (placed.join(nodes, "node").filter(F.col("i") <= F.col("m") - need + 1)
              .join(sets.select("node", "spread"), "node").select("node", "n", "c", "s", "i", "m", "spread"))
    x, y = prefix.alias("x"), prefix.alias("y")
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    by_place = F.least("x.i", "y.i") + F.least(F.col("x.m") - F.col("x.i"), F.col("y.m") - F.col("y.i")) >= overlap
    by_class = F.aggregate(F.zip_with("x.spread", "y.spread", lambda p, q: F.least(p, q)), F.lit(0), lambda t, k: t + k) >= overlap
    meet = (F.col("x.s") == F.col("y.s")) & (F.col("x.c") < F.col("y.c"))
    return x.join(y, meet & by_place & by_class).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
