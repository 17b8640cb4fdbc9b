"""Operator 5: token ids in ORC files, written in the order of the document ids and read back.

Method: ORC stripes. Its integer run-length encoding packs the ids, its row index and a Bloom filter on the
document id let a reader skip stripes, and stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.bpe_units import WordTokenizer, encode_units, fine_units, is_word, load_tokenizer
from tracefold.llm.common import shared_path

#: Units a worker remembers with their ids, in two generations of this size; about 100 MB each.
CACHE_UNITS = 450_000
#: Bytes of text a task encodes at a time; a longer text is encoded whole.
SLICE_BYTES = 1 << 20
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "10000",
               "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


class Encoder:
    """Encodes whole texts; remembers the ids of units it met, those of the last generation or used since."""
    def __init__(self, path: str):
        self.tokenizer, self.known, self.old = load_tokenizer(path), {"": b""}, {}
        self.words = WordTokenizer(self.tokenizer)

    def learn(self, new: list[str]) -> None:
        known, old = self.known, self.old
        words: list[str] = []
        others: list[str] = []
        for u in new:
            if (found := old.get(u)) is not None:
                known[u] = found
            elif self.words.usable and is_word(u):
                words.append(u)
            else:
                others.append(u)
        for some, (ids, at) in ((words, self.words.encode(words)), (others, encode_units(self.tokenizer, others))):
            raw, at = ids.tobytes(), (4 * at).tolist()
            known.update(zip(some, [raw[i:j] for i, j in zip(at, at[1:], strict=False)], strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the place of each text's first one (and the end)."""
        values, first, n = fine_units(texts)
        coded = values.dictionary_encode()
        met = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(met) > CACHE_UNITS:
            self.known, self.old = {"": b""}, self.known
        got = list(map(self.known.get, met))
        if new := [i for i, x in enumerate(got) if x is None]:
            self.learn([met[i] for i in new])
            for i in new:
                got[i] = self.known[met[i]]
        which = coded.indices.to_numpy()[_ranges(first, n)]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids = np.frombuffer(b"".join(got), "<u4")[_ranges((np.cumsum(sizes) - sizes)[which], sizes[which])]
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[np.cumsum(n)]
        return ids, np.concatenate([[0], ends])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + n[i] - 1`` of every i, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


_encoders: dict[str, Encoder] = {}      # of this worker process


def encode_array(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (null: empty), and the place of each text's first one (and the end); the library encodes
    each unit it meets."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(texts)


def encode_texts(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    ids, at = encode_array(path, pa.array(texts, pa.string()))
    return [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def byte_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the strings of ``column`` hold ``SLICE_BYTES`` at most, or are one."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, SLICE_BYTES + (ends[at - 1] if at else 0), "right")))
            yield batch.slice(at, to - at)
            at = to


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id",
                      text: str = "text", files: int | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write ``part, seq, doc_id, ids`` as ORC.

    Rows are range-partitioned and sorted by document id (nulls first; rows of one id by the crc32 of their
    texts), so the files in the order of ``part`` and the rows in the order of ``seq`` are in the order of the
    ids. A null or empty text holds the end id alone.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in byte_slices(batches, "text"):
            ids, at = encode_array(tokenizer_path, batch.column("text"))
            flat = np.insert(ids, at[1:], end_id).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array((at + np.arange(len(at))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(seq, seq + batch.num_rows)), batch.column("doc_id"), lists], names=["seq", "doc_id", "ids"])
            seq += batch.num_rows

    (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .mapInArrow(encode, "seq bigint, doc_id bigint, ids array<int>")
     .withColumn("part", F.spark_partition_id()).write.options(**ORC_OPTIONS).orc(path))


def read_token_store(spark, path: str) -> DataFrame:
    """The store's rows: ``part int, seq long, doc_id long, ids array<int>``."""
    return spark.read.schema("seq bigint, doc_id bigint, ids array<int>, part int").orc(path)


def store_digest(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` for each stored row; ``start`` counts the ids before it.

    Prefix sums have two levels: totals of the files (as many rows as files), then sums inside a file.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    rows = store.select("part", "seq", "doc_id", "ids").mapInArrow(digest, "part int, seq bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    files = store.groupBy("part").agg(F.sum(F.size("ids").cast("bigint")).alias("total"))
    before = files.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return (rows.withColumn("inside", inside).join(before, "part")
            .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def token_store(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the store (to the shared folder unless ``path`` is given) and return its digest, read from the files.

    Each input row gives a row, repeated ids and nulls included; an empty table gives an empty result. Other
    columns of ``docs`` are not read.
    """
    path = path or shared_path(docs.sparkSession, "token-ids")
    write_token_store(docs, path, tokenizer_path, **options)
    return store_digest(read_token_store(docs.sparkSession, path))
