"""Benchmark the headline jobs; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (warm runs per query, default 3). Each job is fully executed
through the ``noop`` sink (no collect), timed as the median of the warm runs
after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tracefold.operators import graph  # noqa: E402
from tracefold.plans import QUERIES, q_graph  # noqa: E402
from tracefold.session import build_session  # noqa: E402
from tracefold.sources import tables as T  # noqa: E402

# headline operator -> (registered job, input table whose rows it consumes)
HEADLINE = {
    "gated_usage_hourly": ("gated_usage_hourly", "events"),
    "record_guard": ("gt1_class_allowlist", "events"),
    "sampler": ("gt11_keyed_sampler", "events"),
    "redaction": ("gt13_field_redaction", "documents"),
    "guardrail_chain": ("gt16_guardrail_chain", "conversations"),
    "decision_fold": ("ag3_guardrail_rollup", "conversations"),
    "retrieval_rollup": ("ag1_retrieval_rollup", "events"),
    "hourly_usage": ("ag7_usage_hourly", "events"),
    "manifest": ("ag8_batch_manifest", "events"),
    "subgraph_read": ("jn4_decision_subgraph", "events"),
    "graph_build": ("jn3_graph_build", "events"),
    "similarity_top_k": ("jn13_similarity_search", "embeddings"),
    "verdict_idempotency": ("sm8_verdict_idempotency", "events"),
}


def scoped_read(spark, sf_dir: str, runs: int) -> dict[str, float]:
    """Median and 95th percentile of reading single decisions from stored documents (target: 0.05 s at the 95th)."""
    path = tempfile.mkdtemp(prefix="tracefold-bench-") + "/documents"
    docs = q_graph.nested_documents(spark, sf_dir)
    graph.write_documents(docs, path)
    schema = spark.read.parquet(path).schema
    some = docs.select("tenant_id", "decision_id").orderBy(F.xxhash64("decision_id")).limit(10 * runs).collect()
    times = []
    for row in some:
        t0 = time.perf_counter()
        graph.read_decision(spark, path, row.tenant_id, row.decision_id, schema).collect()
        times.append(time.perf_counter() - t0)
    times.sort()
    return {"median": round(statistics.median(times), 4), "p95": round(times[int(0.95 * (len(times) - 1))], 4)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app_name="tracefold-bench")
    sizes = {t: T.read_table(spark, sf_dir, t).count() for t in {v[1] for v in HEADLINE.values()}}
    secs, rps = {}, {}
    for name, (job, table) in HEADLINE.items():
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()        # before the query is built: some run jobs while they build
            df = QUERIES[job](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - t0)
        secs[name] = round(statistics.median(times), 4)
        rps[name] = round(sizes[table] / secs[name], 1) if secs[name] > 0 else None
    scoped = scoped_read(spark, sf_dir, runs)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_median_sec",
        "value": round(sum(secs.values()), 4),
        "unit": "sec",
        "queries": secs,
        "scoped_read_sec": scoped,
        "rows_per_sec": rps,
        "input_rows": sizes,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
