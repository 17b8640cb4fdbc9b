import json
import os

from helpers import plain
from pyspark.sql import functions as F

from tracefold.operators import decisions, gates
from tracefold.sources import otlp

TRACE = {"resourceSpans": [{
    "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "curl-smoke"}},
                                {"key": "event_class", "value": {"stringValue": "decision_summary"}}]},
    "scopeSpans": [{"scope": {"name": "decision.curl"}, "spans": [
        {"traceId": "5B8AA5A2D2C872E8321CF37308D69DF2", "spanId": "051581bf3cb55c13", "name": "decision.decision",
         "kind": 1, "startTimeUnixNano": "1713614400000000000", "endTimeUnixNano": "1713614400500000000",
         "attributes": [
             {"key": "event_class", "value": {"stringValue": "decision_summary"}},
             {"key": "decision.tenant_id", "value": {"stringValue": "harness"}},
             {"key": "decision.agent_id", "value": {"stringValue": "curl-smoke"}},
             {"key": "decision.profile", "value": {"stringValue": "permissive-dev"}},
             {"key": "decision.session_id", "value": {"stringValue": "sess-curl"}},
             {"key": "decision.request_id", "value": {"stringValue": "req-curl"}}],
         "events": [
             {"name": "decision.retrieval", "timeUnixNano": "1713614400100000000", "attributes": [
                 {"key": "decision.retrieval.source", "value": {"stringValue": "rag"}},
                 {"key": "decision.retrieval.result_count", "value": {"intValue": "3"}}]},
             {"name": "decision.retrieval", "timeUnixNano": "1713614400200000000", "attributes": [
                 {"key": "decision.retrieval.source", "value": {"stringValue": "kg"}}]},
             {"name": "decision.retrieval", "timeUnixNano": "1713614400300000000", "attributes": [
                 {"key": "decision.retrieval.source", "value": {"stringValue": "rag"}}]},
             {"name": "decision.memory", "timeUnixNano": "1713614400300000000", "attributes": [
                 {"key": "decision.memory.kind", "value": {"stringValue": "semantic"}},
                 {"key": "decision.memory.tags", "value": {"arrayValue": {"values": [{"stringValue": "a"}]}}}]},
             {"name": "decision.guardrail", "timeUnixNano": "1713614400400000000", "attributes": [
                 {"key": "decision.guardrail.blocked", "value": {"boolValue": True}}]}],
         "status": {"code": 1}},
        {"traceId": "5b8aa5a2d2c872e8321cf37308d69df2", "spanId": "00000000000000aa", "parentSpanId": "051581bf3cb55c13",
         "name": "decision.llm_call", "kind": 3, "startTimeUnixNano": "1713614400100000000",
         "endTimeUnixNano": "1713614400200000000", "attributes": [
             {"key": "gen_ai.request.model", "value": {"stringValue": "m-1"}},
             {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "120"}},
             {"key": "decision.llm.usage.output_tokens", "value": {"intValue": "30"}}]},
        {"traceId": "5b8aa5a2d2c872e8321cf37308d69df2", "spanId": "00000000000000bb", "parentSpanId": "051581bf3cb55c13",
         "name": "decision.tool_call", "kind": 1, "startTimeUnixNano": "1713614400200000000",
         "endTimeUnixNano": "1713614400300000000", "attributes": [
             {"key": "tool.name", "value": {"stringValue": "search"}}]}]}]}]}


def test_record_times_are_exact_to_the_microsecond(spark):
    """Nanoseconds since 1970 don't fit a double."""
    times = [1704078023688080000, 1704078023688080999, 1, -1]
    body = [(json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": str(t), "attributes": []}]}]}]}),) for t in times]
    raw = otlp.parse_otlp(spark.createDataFrame(body + [("{cut",), (None,)], "body string"), "body", otlp.OTLP_LOGS)
    got = {r.time_ns: r.us for r in otlp.flatten_records(raw).select("time_ns", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()}
    assert got == {t: t // 1000 for t in times}
    assert raw.filter("_corrupt_record = '{cut'").count() == 1


def test_summary_lengths_and_guardrail_actions(spark):
    def kv(k, **v):
        return {"key": "decision." + k, "value": v}

    def guard(at, *attrs):
        return {"name": "decision.guardrail", "timeUnixNano": str(at), "attributes": list(attrs)}

    span = {"traceId": "aa", "spanId": "01", "name": "decision.decision", "startTimeUnixNano": "0", "endTimeUnixNano": "5000000",
            "attributes": [kv("input_length", intValue="12")],
            "events": [guard(9, kv("guardrail.phase", stringValue="output_final"), kv("guardrail.blocked", boolValue=True), kv("guardrail.pii_count", intValue="2")),
                       guard(3, kv("guardrail.phase", stringValue="input"), kv("guardrail.pii_count", intValue="1"), kv("guardrail.policy", stringValue="pii:EMAIL")),
                       guard(5)]}
    bare = {"traceId": "aa", "spanId": "02", "name": "decision.decision", "startTimeUnixNano": "0", "endTimeUnixNano": "0"}
    body = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, bare]}]}]})
    raw = otlp.parse_otlp(spark.createDataFrame([(body,)], "body string"), "body", otlp.OTLP_TRACES)
    one, two = decisions.decision_summary(otlp.flatten_spans(raw)).orderBy("span_id").collect()
    assert one.guardrail_actions == ["input:redact:pii:EMAIL", "pass", "output_final:block"] and one.pii_detected_count == 3
    assert (one.input_length, one.output_length, one.latency_ms, one.blocked) == (12, None, 5, True)
    assert (two.guardrail_actions, two.pii_detected_count, two.blocked, two.llm_calls, two.models) == ([], 0, False, 0, "")


def _write(scratch, name, obj):
    p = os.path.join(scratch, name)
    os.makedirs(p, exist_ok=True)
    with open(os.path.join(p, "part.json"), "w") as f:
        json.dump(obj, f)
    return p


def test_flatten_spans(spark, scratch):
    raw = otlp.read_otlp(spark, _write(scratch, "traces", TRACE), otlp.OTLP_TRACES)
    spans = otlp.flatten_spans(raw).cache()
    assert spans.count() == 3
    d = spans.filter(F.col("name") == "decision.decision").first()
    assert d.trace_id == "5b8aa5a2d2c872e8321cf37308d69df2" and d.parent_span_id is None
    assert len(d.attrs) == 6 and d.start_ns == 1713614400000000000 and d.status_code == 1
    assert plain(d.resource_attrs)["service.name"] == "curl-smoke"
    assert d.events[0].attrs["decision.retrieval.result_count"].i == 3
    assert d.events[3].attrs["decision.memory.tags"].t == "json"


def test_decision_summary_fold(spark, scratch):
    raw = otlp.read_otlp(spark, _write(scratch, "traces2", TRACE), otlp.OTLP_TRACES)
    s = decisions.decision_summary(otlp.flatten_spans(raw)).first()
    assert s.retrieval_count == 3 and s.retrieval_sources == ["kg", "rag"]
    assert s.memory_write_count == 1 and s.memory_kinds == ["semantic"]
    assert s.blocked is True and s.latency_ms == 500
    assert (s.llm_calls, s.tool_calls, s.input_tokens, s.output_tokens, s.models) == (1, 1, 120, 30, "m-1")
    tree = decisions.span_tree(otlp.flatten_spans(raw)).collect()
    assert sorted(r.name for r in tree) == ["decision.llm_call", "decision.tool_call"]
    assert {r.tenant_id for r in tree} == {"harness"}


def test_guarded_spans_keep_event_trail(spark, scratch):
    raw = otlp.read_otlp(spark, _write(scratch, "traces3", TRACE), otlp.OTLP_TRACES)
    g = gates.guard_spans(otlp.flatten_spans(raw)).filter(F.col("name") == "decision.decision").first()
    assert "event_class" not in g.attrs and "decision.tenant_id" in g.attrs
    assert "event_class" not in g.resource_attrs


def test_flatten_records_and_corrupt_rows(spark, scratch):
    logs = {"resourceLogs": [{"resource": {"attributes": [{"key": "host", "value": {"stringValue": "h"}}]},
                              "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [
                                  {"timeUnixNano": "1713614400000000000", "body": {"stringValue": "hi"},
                                   "attributes": [{"key": "event_class", "value": {"stringValue": "escalation"}},
                                                  {"key": "tenant_id", "value": {"stringValue": "t-1"}},
                                                  {"key": "n", "value": {"intValue": "not-a-number"}}]}]}]}]}
    p = _write(scratch, "logs", logs)
    with open(os.path.join(p, "bad.json"), "w") as f:
        f.write("{not json")
    raw = otlp.read_otlp(spark, p, otlp.OTLP_LOGS).cache()
    assert raw.filter(F.col("_corrupt_record").isNotNull()).count() == 1
    r = otlp.flatten_records(raw).first()
    assert (r.event_class, r.tenant_id, str(r.ts)) == ("escalation", "t-1", "2024-04-20 12:00:00")
    assert r.attrs["n"].i is None and plain(r.resource_attrs) == {"host": "h"}


def test_dual_namespace_coalesce(spark):
    from helpers import records_df

    from tracefold.operators.contracts import coalesce_namespaces
    df = records_df(spark, [{"gen_ai.request.model": "m-a", "decision.llm.usage.input_tokens": 7},
                            {"decision.llm.request.model": "m-b", "gen_ai.usage.input_tokens": 9}])
    cols = coalesce_namespaces(F.col("attrs"), [("model", "str", "gen_ai.request.model", "decision.llm.request.model"),
                                                 ("input_tokens", "int", "gen_ai.usage.input_tokens",
                                                  "decision.llm.usage.input_tokens")])
    rows = df.orderBy("rid").select(*cols).collect()
    assert [(r.model, r.input_tokens) for r in rows] == [("m-a", 7), ("m-b", 9)]


def test_log_pipeline_end_to_end(spark, scratch):
    """OTLP logs -> guard -> redact -> policy (over the attribute map) -> sampler, in the deployed order."""
    import hashlib
    import hmac as hm

    from tracefold.operators import policy, redaction, sampling

    def kv(k, v):
        return {"key": k, "value": {"intValue": str(v)} if isinstance(v, int) else {"stringValue": v}}

    recs = [
        [kv("event_class", "decision_summary"), kv("tenant_id", "t-1"), kv("agent_id", "a-1"),
         kv("model", "bob@corp.example"), kv("prompt", "secret"), kv("latency_ms", 120)],
        [kv("event_class", "escalation"), kv("tenant_id", "t-1"), kv("agent_id", "a-2"), kv("reason_code", "r1")],
        [kv("event_class", "decision_summary"), kv("tenant_id", "t-9"), kv("agent_id", "a-1"), kv("latency_ms", 5)],
        [kv("event_class", "unknown"), kv("tenant_id", "t-1")],
    ]
    logs = {"resourceLogs": [{"resource": {"attributes": [kv("service.name", "svc")]}, "scopeLogs": [
        {"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "1713614400000000000", "attributes": a} for a in recs]}]}]}
    raw = otlp.read_otlp(spark, _write(scratch, "e2e", logs), otlp.OTLP_LOGS)
    flat = otlp.flatten_records(raw)
    g = gates.guard_records(flat)                                   # unknown class and 'prompt' removed
    r = redaction.redact_records(g, b"tenant-key", skip=["event_class", "tenant_id", "agent_id"])
    p = policy.policy_gate(r, "attrs['tenant_id'].s = 't-1'")     # policy reads the attribute map
    s = sampling.sample_records(p, b"sampler", {"decision_summary": 1.0, "escalation": 0.0})
    out = [plain(x.attrs) for x in s.collect()]
    assert len(out) == 1
    rec = out[0]
    assert "prompt" not in rec and rec["latency_ms"] == 120
    assert rec["model"] == hm.new(b"tenant-key", b"bob@corp.example", hashlib.sha256).hexdigest()
