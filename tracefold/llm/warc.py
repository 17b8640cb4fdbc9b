"""Operator 6: WARC archives of web pages, with an index.

Method: index first. Writing a record also yields an index row (file, offset, length, URL, digest), and the
index is a table. Reading selects rows of the index, sorts their byte ranges by file and offset, joins ranges
that lie close together into one read, and cuts the records out of it.

Each record is a gzip member of its own, so that any one can be read alone and the file is a usual .warc.gz.
Records of equal payloads are stored once: the page with the largest id holds the response, the others are
revisits that refer to it.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import file_system, shared_path, slices, written
from tracefold.operators.ordering import HOT_KEYS_BROADCAST, split_keys

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: A file that is longer than this is closed.
FILE_BYTES = 512 << 20
#: Ranges less than this apart are read at once, and reads grow no longer than the second (one record may).
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Archive bytes that a reading task takes.
PART_BYTES = 64 << 20
#: Equal payloads that a writing task takes; larger groups are split.
GROUP_ROWS = 4096
DATE = "2024-01-01T00:00:00Z"           # fixed, so that the same pages give the same bytes

INDEX = "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_type string, file string, offset bigint, length bigint"


def _clean(s: str | None) -> str:
    """A header value: line ends would break the record."""
    return "" if s is None else "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in s)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to`` given) has the payload's digest and length but no payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {len(payload)}",
            f"WARC-X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Write a record per row into files under ``path`` and the index into ``path``/index; return the index.

    Every attempt of a task writes files of its own, and the index names those of the attempt that counted, so
    lost executors leave no wrong rows. A null payload is empty; a null id makes a response and never the one
    that revisits refer to. Rows that share the largest id of their payload are all responses. Groups of more than
    ``group_rows`` equal payloads are dealt to several tasks; rows without an id or with a short payload don't move.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    may_repeat = (F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    groups = written(rows.filter(may_repeat).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("k")).filter("k > 1"), "warc-groups")
    rows = with_holders(rows.filter(may_repeat), groups, group_rows).unionByName(rows.filter(~may_repeat).withColumn("holder", F.lit(None).cast("bigint")))
    rows = rows.withColumn("refers_to", F.when(F.col("page_id") < F.col("holder"), F.col("holder")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        system.create_dir(base, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in slices(batches, 256):
                index = []
                for i, u, payload, digest, to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)     # records are members already
                    raw = gzip.compress(record(i, u, payload, digest, to), 1, mtime=0)
                    out.write(raw)
                    index.append((i, u, digest, len(payload), "response" if to is None else "revisit", name, at, len(raw)))
                    at += len(raw)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return read_index(pages.sparkSession, path)


def with_holders(rows: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """``rows`` with the ``holder`` of their digest (``groups``: ``digest, holder, k``); a digest of more than ``most``
    rows is split into parts by a hash of the row, and its holder is copied to each."""
    hot = groups.filter(F.col("k") > most).select(F.col("digest").alias("__digest"), F.ceil(F.col("k") / most).cast("int").alias("__parts"))
    n_hot = hot.count()
    if n_hot == 0:
        return rows.join(groups.select("digest", "holder"), "digest", "left")
    parts = F.when(F.col("k") > most, F.ceil(F.col("k") / most)).otherwise(1).cast("int")
    copies = groups.select("digest", "holder", F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    return split_keys(rows, ["digest"], F.broadcast(hot) if n_hot <= HOT_KEYS_BROADCAST else hot).join(copies, ["digest", "__part"], "left").drop("__part")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def ranges(selected: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """``file, start, stop, cuts``: byte ranges to read, with the offsets and lengths of the records inside.

    A file is first divided into stretches of ``most`` bytes by the records' offsets, so a range starts in one
    stretch and is bounded; inside, a range goes on while the next record lies within ``gap``.
    """
    cut = selected.select("file", "offset", "length", F.floor(F.col("offset") / most).alias("stretch"))
    by = Window.partitionBy("file", "stretch").orderBy("offset")
    far = F.coalesce((F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by) > gap).cast("int"), F.lit(1))
    run = cut.withColumn("far", far).withColumn("run", F.sum("far").over(by))
    return (run.groupBy("file", "stretch", "run")
            .agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("cuts"))
            .select("file", "start", "stop", "cuts"))


def read_warc(selected: DataFrame, path: str, part_bytes: int = PART_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """The selected records, read from the archives: ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload``. The digest and length of a response are taken anew from its payload; a revisit has
    those of its headers and no payload. The index rows are added up first: the ranges are dealt to a task for each
    ``part_bytes`` of archive, at least the session's shuffle partitions, neighbours together."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(path)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for file, start, stop, cuts in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "cuts")), strict=True):
                with system.open_input_file(f"{base}/{file}") as f:
                    raw = f.read_at(stop - start, start)
                out = []
                for cut in cuts:
                    head, payload = parse(gzip.decompress(raw[cut["offset"] - start: cut["offset"] - start + cut["length"]]))
                    page = int(head["WARC-X-Page-ID"]) if head["WARC-X-Page-ID"] else None
                    if head["WARC-Type"] == "response":
                        out.append((page, head["WARC-Target-URI"], len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload))
                    else:
                        out.append((page, head["WARC-Target-URI"], int(head["WARC-X-Payload-Length"]), head["WARC-Payload-Digest"].partition(":")[2], "revisit", int(head["WARC-X-Refers-To-Page-ID"]), None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    total = selected.agg(F.sum("length")).first()[0] or 0
    parts = max(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    # a number given outright is kept, where a sort's partitions would be joined by the size of the index rows
    return ranges(selected, most=read_bytes).repartitionByRange(parts, "file", "start").sortWithinPartitions("file", "start").mapInArrow(read, schema)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all rows, then read all records back. An empty table gives no file and an empty result; extra
    columns are not read; repeated rows each have a record."""
    path = path or shared_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path), path)
