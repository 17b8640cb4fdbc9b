"""Erasure (JN11): closure of a request over sessions, and versioned snapshots that a rewrite switches at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def erase_cascade(rows: DataFrame, requests: DataFrame, user_col: str = "user_id", session_col: str = "session_id",
                  content_cols: Sequence[str] = ("content",), cascade: bool = True) -> DataFrame:
    """Rows with the content of erased users removed, ``content_deleted`` and ``deleted_by``.

    ``requests`` names users. Their own rows lose their content (``deleted_by`` = user); with ``cascade`` so do all other
    rows of the sessions they took part in (session), as what was answered to them tells what they said. Structure, ids
    and order stay. A null user or session is nobody's and no session. Both lists are distinct before they are joined, and
    Spark picks each join by size; a session's rows never meet in one task unless they hash there.
    """
    asked = requests.select(F.col(user_col).alias("__user")).filter("__user IS NOT NULL").distinct()
    own = rows.join(asked, rows[user_col] == F.col("__user"), "left")
    if cascade:
        sessions = rows.join(asked, rows[user_col] == F.col("__user"), "left_semi").select(F.col(session_col).alias("__session")).filter("__session IS NOT NULL").distinct()
        own = own.join(sessions, own[session_col] == F.col("__session"), "left")
    by = F.when(F.col("__user").isNotNull(), "user")
    if cascade:
        by = by.when(F.col("__session").isNotNull(), "session")
    return own.select(*[F.when(by.isNull(), F.col(c)).alias(c) if c in content_cols else F.col(c) for c in rows.columns],
                      by.isNotNull().alias("content_deleted"), by.alias("deleted_by"))


def erasure_events(erased: DataFrame, id_cols: Sequence[str], requester: str, at: str) -> DataFrame:
    """One ``DeletionEvent`` per row that lost its content: its ids, why, who asked, and when."""
    return erased.filter("content_deleted").select(*id_cols, F.lit("DeletionEvent").alias("event"), "deleted_by", F.lit(requester).alias("requester"),
                                                   F.lit(at).cast("timestamp_ntz").alias("ts"))


# --------------------------------------------------------------------------- snapshots
def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *p]))
    return jvm, path, path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version that the pointer file names, None if nothing was ever published."""
    jvm, path, fs = _files(spark, root)
    if not fs.exists(path(POINTER)):
        return None
    stream = fs.open(path(POINTER))
    try:
        return int(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that have a folder, published or not."""
    _, path, fs = _files(spark, root)
    if not fs.exists(path()):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path())]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def write_snapshot(df: DataFrame, root: str, before_switch: Callable[[int], None] | None = None) -> int:
    """Write a new version of a table and publish it; readers see the old version until then.

    The version has a folder of its own, above all that are there, so neither a reader nor ``df`` itself (which may read
    the version it replaces) meets a half-written file. Publishing is one rename of the pointer file over the
    old one. A job that dies before it leaves the old version current and a folder that :func:`drop_old` removes.
    ``before_switch`` is called with the number when all files are written, for checks of the new version.
    """
    spark = df.sparkSession
    number = max([0, *versions(spark, root)]) + 1
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/v={number}")
    if before_switch:
        before_switch(number)
    jvm, path, fs = _files(spark, root)
    new = path(f".{POINTER}-{number}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(str(number).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path().toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(path(POINTER)), over)
    return number


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The published version."""
    number = current_version(spark, root)
    if number is None:
        raise FileNotFoundError(f"no published version in {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/v={number}")


def drop_old(spark: SparkSession, root: str) -> list[int]:
    """Remove every version but the published one: erased content is gone only then. Returns the removed versions."""
    _, path, fs = _files(spark, root)
    gone = [n for n in versions(spark, root) if n != current_version(spark, root)]
    for n in gone:
        fs.delete(path(f"v={n}"), True)
    return gone
