"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"        # what separates words
MASK64 = (1 << 64) - 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, different at each call."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def file_system(path: str):
    """The ``pyarrow.fs`` file system of a path and the path inside it, for tasks that read or write files themselves."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):        # Hadoop writes file:/x, Arrow wants file:///x
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later steps start from the files, so a
    lost executor repeats none of the work above."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0 inside ``tree``, a column without nulls, by ``order``) and ``size`` (the tree's rows).

    Rows are range-sorted and numbered inside their partition; the counts of (partition, tree) give where each
    begins. No task holds a tree and nothing is collected.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, 0
        for batch in slices(batches, 8192):
            seq = []
            for t in batch.column("tree").to_pylist():
                tree, at = (t, at + 1) if t == tree else (t, 0)
                seq.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq, pa.int64())], names=[*batch.schema.names, "seq"])

    by = [F.col("tree"), *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seq_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", seq bigint"
    placed = written(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(number, seq_schema)
                     .withColumn("part", F.spark_partition_id()), name)
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    # a tree has a row for each range partition here, as many as the session's shuffle partitions at most
    window = Window.partitionBy("tree")
    starts = counts.select("tree", "part", (F.sum("rows").over(window.orderBy("part")) - F.col("rows")).alias("start"),
                           F.sum("rows").over(window).alias("size"))
    return (placed.join(starts, ["tree", "part"]).withColumn("pos", (F.col("start") + F.col("seq")).cast("bigint"))
            .withColumn("size", F.col("size").cast("bigint")).drop("part", "seq", "start"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def id_text_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones, which bounds the Python objects alive at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added at its end; an old column of the same name goes."""
    keep = [i for i, n in enumerate(batch.schema.names) if n not in added]
    arrays = [batch.column(i) for i in keep] + list(added.values())
    return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in keep] + list(added))


def added_schema(schema: T.StructType, added: list[T.StructField]) -> T.StructType:
    """Schema of :func:`with_columns`."""
    names = {f.name for f in added}
    return T.StructType([f for f in schema.fields if f.name not in names] + added)


def frequent(counts: DataFrame, weight: str, most: int) -> DataFrame:
    """The heaviest rows of ``counts``, ``most`` at most, without a global sort.

    Weights are put in eighth-octave steps; the result holds every row from the lowest step on at which the
    total stays within ``most``. Ties therefore never split, and the bound holds for any distribution.
    """
    if most <= 0:
        return counts.limit(0)
    step = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1)).cast("double")) * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().collect()        # at most 8 * 63 rows
    floor, total = None, 0
    for row in sorted(sizes, key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        floor = row["step"]
    return counts.limit(0) if floor is None else counts.filter(step >= floor)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(f, schema)
