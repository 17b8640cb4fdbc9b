"""Stream intake and sinks (SC3, SC4, SC5, SC7).

Streams are replayable file or Kafka sources with a checkpoint; sinks run
in ``foreachBatch`` so one micro-batch can fan out to several exporters
after a single ``persist`` (exactly one computation per batch).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, options: dict | None = None) -> DataFrame:
    """SC3: continuous intake of record files (replayable, at-least-once).

    For Kafka pass ``fmt="kafka"`` with its options; the value column then
    needs ``from_json`` with the same explicit schema.
    """
    r = spark.readStream.format(fmt)
    if fmt != "kafka":
        r = r.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load(path) if fmt != "kafka" else r.load()


def write_gated(df: DataFrame, exporters: Sequence[Callable[[DataFrame, int], None]], checkpoint: str,
                every: str = "5 seconds", once: bool = False, query_name: str | None = None):
    """SC4: micro-batched fan-out: each batch is persisted once, then handed
    to every exporter, then released. Returns the running query."""
    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for ex in exporters:
                ex(batch, epoch)
        finally:
            batch.unpersist()

    w = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=every)
    return w.start()


def parquet_exporter(path: str, partition_by: Sequence[str] = (), flush_rows: int | None = None) -> Callable[[DataFrame, int], None]:
    """Idempotent Parquet exporter: each micro-batch epoch owns the directory
    ``batch_epoch=<id>`` and overwrites it, so a batch replayed after a failure
    (same epoch id) replaces its earlier partial output instead of adding to it.
    With ``flush_rows`` a file is closed after so many rows, beside the flush by time that the trigger gives."""
    def ex(batch: DataFrame, epoch: int) -> None:
        w = batch.write.mode("overwrite")
        if flush_rows:
            w = w.option("maxRecordsPerFile", flush_rows)
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path.rstrip('/')}/batch_epoch={epoch}")
    return ex


def dry_run_sink(df: DataFrame, path: str, ts_col: str = "ts", class_col: str = "event_class") -> DataFrame:
    """SC5: write what would have been sent, partitioned by day, and return
    the folder's daily "would have been sent" summary by class.

    A day that is written again replaces its earlier files, so a repeated run
    adds nothing; the summary reads the files, so ``df`` is computed once."""
    d = df.withColumn("day", F.to_date(ts_col))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return would_send_summary(df.sparkSession.read.schema(d.schema).parquet(path), ts_col, class_col)


def would_send_summary(df: DataFrame, ts_col: str = "ts", class_col: str = "event_class") -> DataFrame:
    """SC5 summary: rows per day and class."""
    return df.groupBy(F.to_date(ts_col).alias("day"), F.col(class_col).alias("event_class")).agg(
        F.count(F.lit(1)).alias("would_send"))


#: Bytes that one digest leaf covers, and children of one node of the digest tree.
CHUNK_BYTES = 64 << 20
TREE_FANOUT = 1024
#: Bytes that a task reads at a time.
_READ_BYTES = 4 << 20
_LEAVES = "path string, length long, chunk long, sha256 string"


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def _digest_chunks(batches: Iterator[pd.DataFrame], chunk_bytes: int) -> Iterator[pd.DataFrame]:
    for rows in batches:
        digests = []
        for path, length, chunk in zip(rows["path"], rows["length"], rows["chunk"]):
            left, h = min(chunk_bytes, length - chunk * chunk_bytes), hashlib.sha256()
            system, name = _filesystem(path)
            with system.open_input_file(name) as f:
                f.seek(chunk * chunk_bytes)
                while left > 0:
                    data = f.read(min(_READ_BYTES, left))
                    if not data:
                        raise OSError(f"{path} ends {left} bytes before its listed length")
                    h.update(data)
                    left -= len(data)
            digests.append(h.hexdigest())
        yield rows[["path", "length", "chunk"]].assign(sha256=digests)


def file_leaves(spark: SparkSession, folders: Sequence[str], pattern: str = "*.json", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """SHA-256 of every ``chunk_bytes`` of every file below ``folders``: ``path, length, chunk, sha256``.

    Files are listed without reading them, then each chunk is a row of its own that any task may read, so a file of any
    size is spread over tasks and none holds more than a few megabytes of it. Spark's listing leaves out empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(
        list(folders)).select("path", "length")
    last = (F.ceil(F.col("length") / F.lit(chunk_bytes)) - 1).cast("bigint")
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, "path", "chunk").mapInPandas(lambda it: _digest_chunks(it, chunk_bytes), _LEAVES)


def _parents(level: DataFrame, fanout: Column) -> DataFrame:
    """One tree level up: the digest of the children's hex digests in order; a lone root stays as it is."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("node", "sha256"))), lambda x: x["sha256"])
    up = level.groupBy("path", "length", "n_nodes", F.floor(F.col("node") / fanout).cast("bigint").alias("parent")).agg(kids.alias("kids"))
    return up.select("path", "length", F.ceil(F.col("n_nodes") / fanout).cast("bigint").alias("n_nodes"), F.col("parent").alias("node"),
                     F.when(F.col("n_nodes") == 1, F.col("kids")[0]).otherwise(F.sha2(F.concat_ws("", "kids"), 256)).alias("sha256"))


def file_manifest(leaves: DataFrame, chunk_bytes: int = CHUNK_BYTES, fanout: int = TREE_FANOUT, levels: int = 3) -> DataFrame:
    """Root of each file's digest tree: ``path, n_bytes, n_chunks, sha256``.

    Chunks are the leaves. While a file has several nodes, every ``fanout`` consecutive ones become the SHA-256 of their
    hex digests, so a group holds ``fanout`` short rows at most, whatever the file's size. A file of one chunk keeps that
    chunk's digest, the plain SHA-256 of the file. ``levels`` bounds the tree: a file may have ``fanout ** levels`` chunks
    (64 EB by default); one with more fails.
    """
    n = F.ceil(F.col("length") / F.lit(chunk_bytes)).cast("bigint")
    top = leaves.select("path", "length", n.alias("n_nodes"), F.col("chunk").alias("node"), "sha256")
    for _ in range(levels):
        top = _parents(top, F.lit(fanout))
    root = F.when(F.col("n_nodes") == 1, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("too many chunks for the tree: "), "path")))
    return top.select("path", F.col("length").alias("n_bytes"), n.alias("n_chunks"), root.alias("sha256"))


def verify_manifest(manifest: DataFrame, folders: Sequence[str], pattern: str = "*.json", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Files that differ from their manifest: ``path, problem`` (changed, missing or unlisted); no row if all is well."""
    now = file_manifest(file_leaves(manifest.sparkSession, folders, pattern, chunk_bytes), chunk_bytes).select(
        "path", F.col("sha256").alias("now"))
    j = manifest.select("path", "sha256").join(now, "path", "full")
    problem = (F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted")
               .when(F.col("now") != F.col("sha256"), "changed"))
    return j.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


def export_evidence(datasets: dict[str, DataFrame], root: str, tenant: str, start: str, end: str,
                    ts_cols: dict[str, str] | None = None, tenant_col: str = "tenant_id",
                    chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """SC7: scoped, time-ranged JSON export of several datasets plus a manifest
    of this export's files: ``dataset, path, n_bytes, n_chunks, sha256``.

    Rows of ``tenant`` in ``[start, end)`` go to ``root/<dataset>``, which is
    replaced; other folders of ``root`` are not looked at. Rows without a
    tenant or a time are left out. A dataset without such rows has no file to
    list. The digest is the root of the file's chunk tree (``file_manifest``).
    """
    if not datasets:
        raise ValueError("no datasets to export")
    ts_cols = ts_cols or {}
    spark = next(iter(datasets.values())).sparkSession
    folders = {name: f"{root.rstrip('/')}/{name}" for name in datasets}
    for name, df in datasets.items():
        ts = ts_cols.get(name, "ts")
        scoped = df
        if tenant_col in df.columns:
            scoped = scoped.filter(F.col(tenant_col) == tenant)
        if ts in df.columns:
            scoped = scoped.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
                                   & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
        scoped.write.mode("overwrite").json(folders[name])
    manifest = file_manifest(file_leaves(spark, list(folders.values()), "*.json", chunk_bytes), chunk_bytes)
    return manifest.select(F.element_at(F.split("path", "/"), -2).alias("dataset"), *manifest.columns)


def write_partitioned(df: DataFrame, path: str, ts_col: str = "ts", tenant_col: str = "tenant_id",
                      mode: str = "append") -> None:
    """Persist records partitioned by ``tenant_id`` and ``day`` so tenant-scoped,
    time-ranged reads (GT26, SC7) prune whole directories before any file is
    opened; rows are clustered by class inside files for min/max skipping."""
    (df.withColumn("day", F.to_date(ts_col))
       .repartition(tenant_col, "day").sortWithinPartitions("event_class", ts_col)
       .write.mode(mode).partitionBy(tenant_col, "day").parquet(path))
