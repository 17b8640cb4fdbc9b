"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job assumes. AQE re-plans joins and coalesces small shuffle
# partitions at runtime, and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Attribute maps built from several sources may repeat a key; the last
    # writer wins, as when an attribute is set twice on a span.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Key material for the keyed hashes is inlined as literals; keep it out
    # of plan strings, logs and event logs.
    "spark.sql.redaction.string.regex": "(?i)unhex\\([0-9a-f]{32,}\\)|[0-9a-f]{128}",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tracefold") -> SparkSession:
    """Create (or reuse) a session with the library's defaults.

    On a cluster ``master`` is left to spark-submit and the shuffle partition
    count to the cluster config: size it to the data (roughly input bytes /
    128 MB) and AQE coalesces small partitions and splits skewed ones at
    run time. Local runs (tests, bench) default to 8 partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is None and master and master.startswith("local"):
        shuffle_partitions = 8
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    and the master is local (a test run) do we pick a fresh scratch folder of
    our own: on a cluster every executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tracefold-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable checkpoint).

    Used by iterative jobs so a lost executor does not replay the whole chain.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
