import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tracefold.sources import sinks
from tracefold.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_dry_run_sink_writes_by_day_and_summarises(spark, scratch):
    rec = T.records(spark, SF)
    for _ in range(2):      # a repeated run adds nothing
        summary = sinks.dry_run_sink(rec, os.path.join(scratch, "dry"))
    assert summary.agg(F.sum("would_send")).first()[0] == rec.count()
    days = [d for d in os.listdir(os.path.join(scratch, "dry")) if d.startswith("day=")]
    assert len(days) == rec.select(F.to_date("ts")).distinct().count()


def test_write_gated_fans_out_each_batch_once(spark, scratch):
    rec = T.records(spark, SF)
    src = os.path.join(scratch, "src")
    rec.repartition(2).write.parquet(src)
    stream = sinks.stream_records(spark, src, rec.schema)
    outs = [os.path.join(scratch, "a"), os.path.join(scratch, "b")]
    q = sinks.write_gated(stream, [sinks.parquet_exporter(outs[0]), sinks.parquet_exporter(outs[1], ["event_class"])],
                          os.path.join(scratch, "ck"), once=True)
    q.awaitTermination()
    for o in outs:
        assert spark.read.parquet(o).count() == rec.count()


def test_a_batch_is_flushed_after_so_many_rows(spark, scratch):
    rec = T.records(spark, SF)
    src, out = os.path.join(scratch, "src"), os.path.join(scratch, "out")
    rec.coalesce(1).write.parquet(src)
    q = sinks.write_gated(sinks.stream_records(spark, src, rec.schema), [sinks.parquet_exporter(out, flush_rows=64)], os.path.join(scratch, "ck"), once=True)
    q.awaitTermination()
    per_file = [r[0] for r in spark.read.parquet(out).groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(per_file) == rec.count() and max(per_file) == 64


def test_evidence_export_manifest(spark, scratch):
    esc = T.escalations(spark, SF)
    root = os.path.join(scratch, "bundle")
    man = sinks.export_evidence({"escalation-log": esc}, root, "t-1", "2024-01-01", "2024-01-15",
                                ts_cols={"escalation-log": "requested_at"}).collect()
    assert man, "no files in the manifest"
    n = 0
    for r in man:
        path = r.path.replace("file:", "")
        with open(path, "rb") as f:
            data = f.read()
        assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.n_bytes
        n += sum(1 for line in data.splitlines() if line.strip())
    exp = esc.filter((F.col("tenant_id") == "t-1") & (F.col("requested_at") < F.lit("2024-01-15").cast("timestamp_ntz"))).count()
    assert n == exp


def _tree(data, chunk, fanout):
    """Root of the digest tree by plain Python."""
    level = [hashlib.sha256(data[i:i + chunk]).hexdigest() for i in range(0, len(data), chunk)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return level[0]


def test_digest_tree_of_split_files(spark, scratch):
    rnd = random.Random(3)
    sizes = {"b": 1, "c": 999, "d": 1000, "e": 1001, "f": 4000, "g": 16_001, "h": 64_000}
    data = {n: rnd.randbytes(k) for n, k in sizes.items()}
    for n, d in data.items():
        with open(os.path.join(scratch, n + ".json"), "wb") as f:
            f.write(d)
    leaves = sinks.file_leaves(spark, [scratch], chunk_bytes=1000)
    assert leaves.count() == sum(-(-k // 1000) for k in sizes.values())
    got = {os.path.basename(r.path)[0]: r for r in sinks.file_manifest(leaves, 1000, fanout=4).collect()}
    assert {n: (r.n_bytes, r.sha256) for n, r in got.items()} == {n: (len(d), _tree(d, 1000, 4)) for n, d in data.items()}
    assert [got[n].n_chunks for n in "bcdefgh"] == [1, 1, 1, 2, 4, 17, 64]
    with pytest.raises(Exception, match="too many chunks"):
        sinks.file_manifest(leaves, 1000, fanout=2, levels=3).collect()


def test_manifest_is_of_this_export_and_finds_changes(spark, scratch):
    esc = T.escalations(spark, SF).repartition(2)
    args = (scratch, "t-1", "2024-01-01", "2024-03-01", {"old": "requested_at", "new": "requested_at"})
    sinks.export_evidence({"old": esc}, *args)
    man = sinks.export_evidence({"new": esc}, *args, chunk_bytes=500)
    rows = man.collect()
    assert {r.dataset for r in rows} == {"new"} and max(r.n_chunks for r in rows) > 1
    kept = spark.createDataFrame(rows, man.schema)
    folder = os.path.join(scratch, "new")
    assert sinks.verify_manifest(kept, [folder], chunk_bytes=500).isEmpty()
    files = sorted(f for f in os.listdir(folder) if f.endswith(".json"))
    with open(os.path.join(folder, files[0]), "r+b") as f:
        f.seek(700)
        f.write(b"#")
    for crc in (f for f in os.listdir(folder) if f.endswith(".crc")):
        os.unlink(os.path.join(folder, crc))
    with open(os.path.join(folder, "more.json"), "w") as f:
        f.write("{}")
    found = {os.path.basename(r.path): r.problem for r in sinks.verify_manifest(kept, [folder], chunk_bytes=500).collect()}
    assert found == {files[0]: "changed", "more.json": "unlisted"}


def test_tenant_scope_prunes_partitions_and_columns(spark, scratch):
    from tracefold.operators import policy
    path = os.path.join(scratch, "recs")
    sinks.write_partitioned(T.records(spark, SF), path)
    df = spark.read.parquet(path)
    q = policy.tenant_scope(df, "t-2").filter(F.col("event_class") == "escalation").select("decision_id", "latency_ms")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(tenant_id#" in plan
    assert "PushedFilters: [IsNotNull(event_class), EqualTo(event_class,escalation)]" in plan
    assert "ReadSchema: struct<decision_id:bigint,event_class:string,latency_ms:bigint>" in plan
    exp = T.records(spark, SF).filter("tenant_id = 't-2' AND event_class = 'escalation'").count()
    assert q.count() == exp
