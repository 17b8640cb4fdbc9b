"""The stages in deployed order: first failing stage, redacted values, reconciling counts."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tracefold.operators import gate_pipeline

SF = "/root/testdata/sf0.01"
ATTRS = ["event_class", "tenant_id", "agent_id", "latency_ms", "note"]
SCHEMA = "id long, event_class string, tenant_id string, agent_id string, latency_ms long, note string, ts timestamp_ntz"
ARGS = {"rates": {}, "redact_key": b"t", "skip": ["tenant_id", "agent_id"], "extra": {"decision_summary": ["note"]}, "predicate": "latency_ms < 10"}


def _frame(spark, *rows):
    ts = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, *r, ts) for i, r in enumerate(rows)], SCHEMA)


def test_first_failing_stage_and_redacted_values(spark):
    df = _frame(spark,
                ("decision_summary", "t", "a", 1, "  a@example.com "),      # 0 hashed, without the blanks around it
                ("decision_summary", "t", "a", 1, " plain "),               # 1 as it was
                ("decision_summary", "t", "a", 99, "a@example.com"),        # 2 policy
                ("decision_summary", "t", "a", 1, "x" * 70_000),            # 3 the redaction request is too long
                ("nothing", "t", "a", 1, "a@example.com"),                  # 4 unknown class
                (None, "t", "a", 1, None),                                  # 5 no class
                ("escalation", "t", "a", 1, "a@example.com"),               # 6 the guard takes latency and note away
                ("decision_summary", None, None, 1, None),                  # 7 nulls pass
                ("decision_summary", "t", "a", 1, ""))                      # 8
    rows = {r.id: r for r in gate_pipeline.staged(df, ATTRS, b"k", max_bytes=100_000, **ARGS).collect()}
    assert {i: r.drop_reason for i, r in rows.items()} == {0: None, 1: None, 2: "policy", 3: "redaction", 4: "schema", 5: "schema", 6: "policy", 7: None, 8: None}
    assert rows[0].note == hmac.new(b"t", b"a@example.com", hashlib.sha256).hexdigest() and rows[0].hashed_note
    assert (rows[1].note, rows[1].hashed_note, rows[7].note, rows[8].note) == (" plain ", False, None, "")
    small = {r.id: r for r in gate_pipeline.staged(df, ATTRS, b"k", **ARGS).collect()}
    assert small[3].drop_reason is None and small[3].note is None and small[3].oversized_note and not small[0].oversized_note


def test_sampler_is_last_and_gated_keeps_the_columns(spark):
    df = _frame(spark, ("decision_summary", "t", "a", 1, "x"), ("decision_summary", "t", "a", 99, "x"))
    args = {**ARGS, "rates": {"decision_summary": 0.0}}
    assert [r.drop_reason for r in gate_pipeline.staged(df, ATTRS, b"k", **args).orderBy("id").collect()] == ["sampler", "policy"]
    kept = gate_pipeline.gated(df, ATTRS, b"k", **ARGS)
    assert kept.columns == df.columns and kept.count() == 1
    assert gate_pipeline.staged(df.limit(0), ATTRS, b"k", **ARGS).count() == 0


def test_record_without_any_attribute_left_fails_the_schema(spark):
    df = _frame(spark, ("escalation", "t", "a", 1, "x"))
    out = gate_pipeline.staged(df, ["latency_ms"], b"k", {}).first()
    assert out.drop_reason == "schema" and out.latency_ms is None


@pytest.fixture(scope="module")
def manifest(spark):
    return E.queries()["ag8_batch_manifest"](spark, SF).drop("batch").agg(*[F.sum(c).alias(c) for c in (
        "input_count", "output_count", "dropped_schema", "dropped_redaction", "dropped_policy", "dropped_sampler",
        "hashed_internal_note", "oversized_internal_note")]).first().asDict()


def test_counts_of_the_pipeline_jobs_reconcile(spark, manifest):
    q = E.queries()
    m = manifest
    assert m["input_count"] == sum(v for k, v in m.items() if k.startswith(("output", "dropped")))
    assert min(m[k] for k in m if k != "dropped_redaction") > 0
    assert q["sm1_streaming_gate"](spark, SF).count() == m["output_count"]
    assert q["sc5_dry_run_summary"](spark, SF).agg(F.sum("would_send")).first()[0] == m["output_count"]
    by = {r[0]: r[1] for r in q["ag9_stage_metrics"](spark, SF).groupBy("outcome").agg(F.sum("n_events")).collect()}
    assert by == {"sent": m["output_count"], **{k: v for k, v in m.items() if k.startswith("dropped") and v}}


def test_no_address_leaves_the_gate(spark, manifest):
    out = E.queries()["sm1_streaming_gate"](spark, SF)
    assert out.filter(F.col("internal_note").contains("@")).count() == 0
    assert out.filter(F.col("internal_note").rlike("^[0-9a-f]{64}$")).count() == manifest["hashed_internal_note"]


def test_merged_sketches_are_within_their_error(spark):
    """One class holds most rows; sketches of 40 days merged against the exact ranks."""
    import random

    from tracefold.operators import accounting
    rnd = random.Random(3)
    rows = [("hot" if i % 10 else "cold", i % 40, int(rnd.lognormvariate(4, 1))) for i in range(40_000)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "cls string, day int, ms long")
    sketches = accounting.latency_sketches(df, ["cls", "day"], "ms")
    assert sketches.select(F.max(F.octet_length("sketch"))).first()[0] < 20_000
    for r in accounting.merged_percentiles(sketches, ["cls"]).collect():
        values = sorted(ms for cls, _, ms in rows if cls == r.cls)
        assert r.n == len(values)
        for q, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            low, high = sum(v < got for v in values) / len(values), sum(v <= got for v in values) / len(values)
            assert low - 0.01 <= q <= high + 0.01, (r.cls, q, got)
