"""Operator 1: token counts without token ids.

Method: count the pieces of each distinct pre-token unit once, join the counts to the units' frequencies in
each document, and sum. Ids are never materialised. The join is cut in two: units that are frequent in the
corpus (a fixed number at most) go to every task as a dictionary, all others are joined by a shuffle. So the
shuffled rows are rare units only, and no join key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.bpe_units import encode_units, load_tokenizer, units
from tracefold.llm.common import frequent, slices, written

#: Units in the dictionary that goes to every task; about 40 MB there.
HEAD_UNITS = 300_000
#: Distinct units a task holds while it counts.
FLUSH_UNITS = 300_000


def unit_totals(texts: DataFrame) -> DataFrame:
    """(unit, n): occurrences of each distinct unit over all rows of the column ``text``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["unit", "n"])

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                c.update(units(text or ""))
            if len(c) > FLUSH_UNITS:
                yield out()
                c.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def unit_pieces(totals: DataFrame, tokenizer_path: str) -> DataFrame:
    """(unit, n, pieces): each distinct unit encoded once, by the tokenizers library."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        for batch in slices(batches, 8192):
            lens = np.diff(encode_units(tokenizer, batch.column("unit").to_pylist())[1])
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n"), pa.array(lens, pa.int64())], names=["unit", "n", "pieces"])

    return totals.mapInArrow(pieces, "unit string, n bigint, pieces bigint")


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = 512, head_units: int = HEAD_UNITS) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit``, a row for each input row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and repeated or null ids each keep a row of
    their own. An empty table gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    table = written(unit_pieces(unit_totals(rows), tokenizer_path), "pieces")
    head = spark.sparkContext.broadcast({r[0]: r[1] for r in frequent(table, "n", head_units).select("unit", "pieces").collect()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.get
        for batch in slices(batches):
            row, ids, size, sums, unit, freq = [], [], [], [], [], []
            for r, i, t in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                us = units(t or "")
                lens = [known(u, 0) for u in us]        # a unit has a piece at least, so 0 means not in the head
                row.append(r)
                ids.append(i)
                size.append(len((t or "").encode()))
                sums.append(sum(lens))
                unit.append(None)
                freq.append(None)
                if 0 in lens:
                    for u, k in Counter(u for u, n in zip(us, lens, strict=True) if not n).items():
                        row.append(r)
                        ids.append(None)
                        size.append(None)
                        sums.append(None)
                        unit.append(u)
                        freq.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in ((row, pa.int64()), (ids, pa.int64()), (size, pa.int64()), (sums, pa.int64()), (unit, pa.string()), (freq, pa.int64()))],
                names=["row", "doc_id", "n_bytes", "n", "unit", "freq"])

    parts = written(rows.mapInArrow(split, "row bigint, doc_id bigint, n_bytes bigint, n bigint, unit string, freq bigint"), "unit-frequencies")
    rare = (parts.filter(F.col("unit").isNotNull()).select("row", "unit", "freq")
            .join(table.select("unit", "pieces"), "unit")
            .select("row", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_bytes"), (F.col("freq") * F.col("pieces")).alias("n")))
    summed = parts.filter(F.col("unit").isNull()).select("row", "doc_id", "n_bytes", "n").unionByName(rare).groupBy("row")
    return (summed.agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
