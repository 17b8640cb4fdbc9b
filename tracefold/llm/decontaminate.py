"""Operator 10: benchmark passages in documents.

Method: the CGK random walk embeds a string so that a small edit distance becomes a small Hamming distance. The
walk reads a window word by word, writes the word it stands on at each step, and a random function of (step,
word) says whether it moves on; after an edit, two walks meet again soon. Windows of the items' size start at
every word; a few sampled steps of the embedding are a hash key, and several walks with several samples each
make the recall reach its target. A window that shares a key with an item is compared with it by exact edit
distance, over words.

Only stretches that can hold a match are walked: an item of n words with k edits keeps a run of n // (k + 1) of
its words in order, so windows far from any run that some item has are left out without loss.

Items lie in blocks of bounded size in the shared folder. A task reads a stretch of documents once and searches it
for one block after the other, each read and built inside the task, so any number of items will do and none goes
through the driver.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm.common import file_system, shared_path, slices, written
from tracefold.llm.near_dup import mix

#: Edits allowed, as a share of an item's words.
EDITS = 0.15
#: Walks, samples of each, and steps in a sample.
WALKS, SAMPLES, STEPS = 6, 4, 3
#: Words of the items in a block, about, and blocks that a Python worker keeps.
BLOCK_WORDS = 500_000
BLOCKS_KEPT = 2
#: Bytes of texts that are searched for one block before the next (one text may be longer): of the second number if
#: the worker can't keep all blocks and loads them anew for each stretch.
STRETCH_BYTES, RELOAD_BYTES = 1 << 20, 64 << 20
SEED = 0xC6_4B

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_TO_BLANK = bytes(b if b > 127 or b in _KEPT else 32 for b in range(256))

HITS = "doc_id bigint, item_id bigint, distance int, n_words int, start_word bigint, end_word bigint"


def words(text: bytes | None) -> list[bytes]:
    """A-Z in lower case; ASCII characters other than letters and digits divide words."""
    return text.lower().translate(_TO_BLANK).split() if text else []


def edits_of(n: int, share: float = EDITS) -> int:
    return int(n * share + 1e-9)


def walk(seqs: np.ndarray, starts: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK embeddings (starts x steps) of the windows of ``seqs`` that begin at ``starts``.

    ``seqs`` holds word numbers and must go on for at least ``steps`` places after each start.
    """
    at = starts.astype(np.int64).copy()
    out = np.empty((len(starts), steps), np.int32)
    for j in range(steps):
        word = seqs[at]
        out[:, j] = word
        at += ((mix(word.astype(np.uint64) ^ np.uint64(seed + 7919 * j)) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return out


def distance_in(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """The least edit distance between the item and any stretch of the text, and that stretch (start, end).

    Of equal distances the earliest end and, for that, the latest start counts.
    """
    row = [(0, j) for j in range(len(text) + 1)]
    for i, x in enumerate(item, 1):
        new = [(i, 0)]
        for j, y in enumerate(text, 1):
            swap, drop, add = row[j - 1], row[j], new[j - 1]
            a = (swap[0] + (x != y), swap[1])
            b, c = (drop[0] + 1, drop[1]), (add[0] + 1, add[1])
            best = a if a[0] <= b[0] and a[0] <= c[0] else b if b[0] <= c[0] else c
            new.append(best)
        row = new
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], row[end][1], end


@dataclass
class Block:
    """Items, their words' numbers, runs and hash tables: what a task needs to search for them."""
    number: dict[bytes, int]
    items: list[tuple[int, list[int]]]          # (item_id, word numbers)
    q: int                                      # length of the runs
    runs: np.ndarray                            # sorted hashes of all runs
    longest: int
    steps: int
    tables: list[tuple[int, np.ndarray, dict[int, list[int]], np.ndarray]]   # (seed, sampled steps, key -> items, sorted keys)
    share: float


def size_class(n: int) -> int:
    """Items are put in classes by length, each a third longer than the one before; returns the least length."""
    least = 1
    while least + max(1, least // 3) <= n:
        least += max(1, least // 3)
    return least


def run_hashes(numbers: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q numbers from each place on."""
    n = len(numbers) - q + 1
    x = np.zeros(max(n, 0), np.uint64)
    for i in range(q):
        x = mix(x) + numbers[i: i + len(x)].astype(np.uint64)
    return x


def key_of(embedded: np.ndarray, sample: np.ndarray) -> np.ndarray:
    x = np.zeros(len(embedded), np.uint64)
    for j in sample:
        x = mix(x) + embedded[:, j].astype(np.uint64)
    return x


def build(rows: list[tuple[int, bytes]], share: float = EDITS, walks: int = WALKS, samples: int = SAMPLES, steps: int = STEPS) -> Block:
    """The search structures for a block of (item_id, text). Items without words are left out."""
    number: dict[bytes, int] = {}
    items = []
    for i, text in rows:
        w = [number.setdefault(x, len(number) + 1) for x in words(text)]
        if w:
            items.append((i, w))
    q = min((len(w) // (edits_of(len(w), share) + 1) for _, w in items), default=1)
    runs = [run_hashes(np.array(w, np.int32), q) for _, w in items]
    longest = max((len(w) for _, w in items), default=0)
    rng = np.random.default_rng(SEED)
    tables = []
    by_class: dict[int, list[int]] = {}
    for k, (_, w) in enumerate(items):
        by_class.setdefault(size_class(len(w)), []).append(k)
    reach = 2 * longest + 2
    for a in range(walks):
        seed = SEED + 1_000_003 * a
        for least, those in sorted(by_class.items()):
            flat = np.concatenate([np.array(items[k][1] + [0] * reach, np.int32) for k in those])
            starts = np.cumsum([0] + [len(items[k][1]) + reach for k in those[:-1]])
            # a walk reads a word in two steps; samples stay well within the shortest item of the class
            span = max(1, 3 * least // 2)
            embedded = walk(flat, starts, span, seed)
            for _ in range(samples):
                sample = np.sort(rng.choice(span, min(steps, span), replace=False))
                buckets: dict[int, list[int]] = {}
                for k, key in zip(those, key_of(embedded, sample).tolist(), strict=True):
                    buckets.setdefault(key, []).append(k)
                tables.append((seed, sample, buckets, np.sort(np.fromiter(buckets, np.uint64, len(buckets)))))
    return Block(number, items, q, np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64), longest,
                 max((int(s[-1]) + 1 for _, s, _, _ in tables), default=0), tables, share)


def search(block: Block, numbers: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item index, distance, start, end) of the best match of each item found in one text's word numbers."""
    n, q, longest = len(numbers), block.q, block.longest
    if n < q or not len(block.runs):
        return []
    hashes = run_hashes(numbers, q)
    known = np.searchsorted(block.runs, hashes)
    at = np.flatnonzero((block.runs[np.minimum(known, len(block.runs) - 1)] == hashes) & (numbers[: len(hashes)] > 0))
    if not len(at):
        return []
    slack = edits_of(longest, block.share)
    marks = np.zeros(n + 1, np.int32)               # windows that may hold a run
    np.add.at(marks, np.maximum(at - longest - slack, 0), 1)
    np.add.at(marks, np.minimum(at + slack + 1, n), -1)
    starts = np.flatnonzero(np.cumsum(marks[:n]) > 0)
    padded = np.concatenate([numbers, np.zeros(block.steps + 1, np.int32)])
    near: dict[int, list[int]] = {}
    seed, embedded = None, None
    for walk_seed, sample, buckets, wanted in block.tables:
        if walk_seed != seed:
            seed, embedded = walk_seed, walk(padded, starts, block.steps, walk_seed)
        keys = key_of(embedded, sample)
        place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        for w in np.flatnonzero(wanted[place] == keys).tolist():
            for k in buckets[int(keys[w])]:
                near.setdefault(k, []).append(int(starts[w]))
    out = []
    for k, found in near.items():
        w = block.items[k][1]
        allowed = edits_of(len(w), block.share)
        best = None
        found.sort()
        i = 0
        while i < len(found):                       # windows that overlap are compared at once
            low, high = found[i], found[i]
            while i < len(found) and found[i] <= high + len(w):
                high = found[i]
                i += 1
            a, b = max(0, low - 2 * allowed), min(n, high + len(w) + 2 * allowed)
            d, s, e = distance_in(w, numbers[a:b].tolist())
            if d <= allowed and (best is None or d < best[1]):
                best = (k, d, a + s, a + e)
        if best:
            out.append(best)
    return out


def write_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> tuple[str, list[int]]:
    """Write the items with words into one folder per block; returns the path and the blocks' numbers.

    A block is a hash class of the items, of ``block_words`` words on average.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = [len(words(t)) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["i", "t", "n"])

    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).cast("binary").alias("t")).filter("i is not null and t is not null")
    counted = written(rows.mapInArrow(count, "i bigint, t binary, n bigint").filter("n > 0"), "items")
    total = counted.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    path = shared_path(items.sparkSession, "item-blocks")
    placed = counted.select("i", "t", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).alias("block"))
    placed.repartition(min(blocks, 1000), "block").write.partitionBy("block").parquet(path)
    return path, sorted(r[0] for r in placed.select("block").distinct().collect())      # one number a block


_kept: OrderedDict[tuple[str, int, float], Block] = OrderedDict()


def load_block(path: str, block: int, share: float) -> Block:
    """The search structures of a block, kept by the worker while it works on them."""
    key = (path, block, share)
    if key not in _kept:
        while len(_kept) >= BLOCKS_KEPT:
            _kept.popitem(last=False)
        system, base = file_system(path)
        rows = ds.dataset(f"{base}/block={block}", filesystem=system, format="parquet").to_table(columns=["i", "t"])
        _kept[key] = build(sorted(zip(rows["i"].to_pylist(), rows["t"].to_pylist(), strict=True)), share)
    _kept.move_to_end(key)
    return _kept[key]


def stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """Ids and texts in lists of at most ``most`` bytes of texts (one text may be longer)."""
    held: list[tuple[int | None, bytes | None]] = []
    size = 0
    for batch in slices(batches, 512):
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if held and size + len(t or b"") > most:
                yield held
                held, size = [], 0
            held.append((i, t))
            size += len(t or b"")
    if held:
        yield held


def find_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", share: float = EDITS, block_words: int = BLOCK_WORDS, stretch_bytes: int | None = None) -> DataFrame:
    """``doc_id, item_id, distance, n_words, start_word, end_word``: a row for each document that holds an item.

    A document holds an item if a stretch of its words is within ``share`` edits of the item's words. The best
    match of each item counts (of equal ones the first). Documents that hold none have no row. Null and empty
    texts hold nothing; null and empty items are in nothing; repeated items with ids of their own each match,
    and repeated rows give repeated rows; a null document id is returned as null. Very long texts are searched
    whole. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    path, blocks = write_blocks(items, item_id, item_text, block_words)
    most = stretch_bytes or (STRETCH_BYTES if len(blocks) <= BLOCKS_KEPT else RELOAD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for texts in stretches(batches, most):
            for b in blocks:
                block = load_block(path, b, share)
                number = block.number.get
                out = []
                for i, t in texts:
                    w = words(t)
                    numbers = np.fromiter([number(x, 0) for x in w], np.int32, len(w))
                    for k, d, s, e in search(block, numbers):
                        out.append((i, block.items[k][0], d, len(block.items[k][1]), s, e))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

    return rows.mapInArrow(run, T.StructType.fromDDL(HITS))
