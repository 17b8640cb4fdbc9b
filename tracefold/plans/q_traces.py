"""Registered jobs over trace and log requests (SC1, SC2, SC7, GT20, JN1, JN2 over spans)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.operators import decisions
from tracefold.plans.oracle_views import with_views
from tracefold.plans.registry import register
from tracefold.session import cut_lineage, ensure_checkpoint_dir
from tracefold.sources import otlp, sinks
from tracefold.sources import tables as T

_RETRIEVAL_SQL = "[" + ", ".join(f"'{s}'" for s in C.RETRIEVAL_SOURCES) + "]"
_MEMORY_SQL = "[" + ", ".join(f"'{s}'" for s in C.MEMORY_KINDS) + "]"


def turn_trace_spans(spark, sf_dir) -> DataFrame:
    return otlp.flatten_spans(otlp.parse_otlp(T.turn_traces(spark, sf_dir), "body", otlp.OTLP_TRACES))


@register("sc1_flatten_spans", with_views("turn_calls") + f"""
SELECT trace_id, span_id, NULL AS parent_span_id, 'decision.decision' AS name, latency_ms, CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END AS status_code,
       CASE WHEN k % 13 = 0 THEN 'TimeoutError' END AS status_message, 'agent-' || CAST(conv_id % 3 AS VARCHAR) AS service,
       CASE WHEN k % 8 <> 0 THEN 6 ELSE 5 END AS n_attrs,
       CAST((k % 4 <> 0) AS INT) + CAST((k % 2 = 0) AS INT) + CAST((k % 5 = 0) AS INT) + CAST((k % 3 <> 2) AS INT) + CAST((k % 7 = 0) AS INT)
         + CAST((k % 10 = 0) AS INT) AS n_events FROM turn_calls
UNION ALL
SELECT trace_id, llm_id, span_id, 'decision.llm_call', latency_ms - 1, NULL, NULL, 'agent-' || CAST(conv_id % 3 AS VARCHAR),
       3 + CAST((k % 3 <> 0) AS INT) + CAST((k % 3 <> 1) AS INT) + CAST((k % 2 = 0) AS INT), 0 FROM turn_calls
UNION ALL
SELECT trace_id, tool_id, CASE WHEN k % 11 = 0 THEN lost_id ELSE span_id END, 'decision.tool_call', latency_ms - 1, NULL, NULL,
       'agent-' || CAST(conv_id % 3 AS VARCHAR), 2, 0 FROM turn_calls WHERE k % 2 = 1""")
def sc1_flatten_spans(spark, sf_dir):
    """Trace requests of every assistant turn flattened to spans: parent, status, times, resource, attributes, events."""
    ms = F.floor((F.col("end_ns") - F.col("start_ns")) / 1_000_000).cast("bigint")
    return turn_trace_spans(spark, sf_dir).select(
        "trace_id", "span_id", "parent_span_id", "name", ms.alias("latency_ms"), "status_code", "status_message",
        F.col("resource_attrs")["service.name"]["s"].alias("service"), F.size("attrs").alias("n_attrs"), F.size("events").alias("n_events"))


@register("sc2_flatten_records", with_views("records") + """
SELECT CAST(decision_id AS VARCHAR) AS body, event_class, CASE WHEN decision_id % 17 <> 0 THEN tenant_id END AS tenant_id, agent_id,
       date_trunc('microsecond', ts) AS ts, latency_ms, CAST(cost_usd AS DOUBLE) AS cost_usd, decision_id % 2 = 0 AS cached,
       'h' || CAST(decision_id % 5 AS VARCHAR) AS host
FROM records WHERE decision_id % 97 <> 0""")
def sc2_flatten_records(spark, sf_dir):
    """Log requests of all records flattened and typed; texts that were cut short give no record."""
    raw = otlp.parse_otlp(T.record_requests(spark, sf_dir), "body", otlp.OTLP_LOGS)
    a = F.col("attrs")
    return otlp.flatten_records(raw).select(
        F.get_json_object("body_json", "$.stringValue").alias("body"), "event_class", "tenant_id", "agent_id", "ts",
        a["latency_ms"]["i"].alias("latency_ms"), a["cost_usd"]["d"].alias("cost_usd"), a["cached"]["b"].alias("cached"),
        F.col("resource_attrs")["host.name"]["s"].alias("host"))


@register("gt20_call_rows", with_views("turn_calls") + """
SELECT trace_id, llm_id AS span_id, span_id AS parent_span_id, 'llm' AS call, model, input_tokens, output_tokens,
       NULL AS tool_name, NULL::BIGINT AS result_count FROM turn_calls
UNION ALL
SELECT trace_id, tool_id, CASE WHEN k % 11 = 0 THEN lost_id ELSE span_id END, 'tool', NULL, NULL, NULL,
       CASE k % 4 WHEN 1 THEN 'search' WHEN 3 THEN 'lookup' END, k % 9 FROM turn_calls WHERE k % 2 = 1""")
def gt20_call_rows(spark, sf_dir):
    """LLM and tool calls as typed rows, each field from whichever attribute namespace has it."""
    return decisions.call_rows(turn_trace_spans(spark, sf_dir)).select(
        "trace_id", "span_id", "parent_span_id", "call", "model", "input_tokens", "output_tokens", "tool_name", "result_count")


@register("jn1_span_tree", with_views("turn_calls") + """
SELECT trace_id, llm_id AS span_id, span_id AS decision_span_id, 'decision.llm_call' AS name, tenant_id, agent_id FROM turn_calls
UNION ALL
SELECT trace_id, tool_id, span_id, 'decision.tool_call', tenant_id, agent_id FROM turn_calls WHERE k % 2 = 1 AND k % 11 <> 0""")
def jn1_span_tree(spark, sf_dir):
    """Call spans with their decision's identity; a call whose parent span is lost has none."""
    return decisions.span_tree(turn_trace_spans(spark, sf_dir)).select(
        "trace_id", "span_id", "decision_span_id", "name", "tenant_id", "agent_id")


_ACTION_SQL = f"""
CASE WHEN k % 3 <> 2 THEN CASE WHEN k % 2 = 0 THEN 'input' ELSE 'output_final' END || ':'
     || CASE WHEN k % 6 = 0 THEN 'block' WHEN k % 3 <> 0 THEN 'redact' ELSE 'pass' END || ':rail:r' || CAST(k % 4 AS VARCHAR) END"""


@register("jn2_span_summary", with_views("turn_calls") + f"""
SELECT trace_id, span_id, tenant_id, agent_id, 's' || CAST(conv_id AS VARCHAR) AS session_id,
       's' || CAST(conv_id AS VARCHAR) || ':t' || CAST(turn AS VARCHAR) AS request_id, latency_ms,
       CASE WHEN k % 8 <> 0 THEN chars % 500 END AS input_length, chars AS output_length,
       CAST(CASE k % 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pii_detected_count,
       CAST((k % 4 <> 0) AS INT) + CAST((k % 2 = 0) AS INT) AS retrieval_count,
       array_to_string(list_sort(list_distinct(list_filter([CASE WHEN k % 4 <> 0 THEN {_RETRIEVAL_SQL}[k % 7 + 1] END,
         CASE WHEN k % 2 = 0 THEN {_RETRIEVAL_SQL}[k % 3 + 1] END], lambda x: x IS NOT NULL))), ',') AS retrieval_sources,
       CAST((k % 5 = 0) AS INT) AS memory_write_count, CASE WHEN k % 5 = 0 THEN {_MEMORY_SQL}[conv_id % 3 + 1] ELSE '' END AS memory_kinds,
       k % 6 = 0 AS blocked, concat_ws(',', {_ACTION_SQL}, CASE WHEN k % 7 = 0 THEN 'output_final:redact' END) AS guardrail_actions,
       CAST((k % 10 = 0) AS INT) AS escalation_events, CAST(1 AS BIGINT) AS llm_calls,
       CAST(CASE WHEN k % 2 = 1 AND k % 11 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS tool_calls, input_tokens, output_tokens, model AS models,
       CASE WHEN k % 13 = 0 THEN 2 ELSE 1 END AS status_code
FROM turn_calls""")
def jn2_span_summary(spark, sf_dir):
    """One summary per decision span: identity, lengths, latency, event roll-ups, guardrail actions, call usage."""
    s = decisions.decision_summary(turn_trace_spans(spark, sf_dir))
    joined = ("retrieval_sources", "memory_kinds", "guardrail_actions")
    return s.drop("start_ns", "end_ns", "status_message").withColumns({c: F.array_join(c, ",") for c in joined})


EVIDENCE_TENANT, EVIDENCE_START, EVIDENCE_END = "t-1", "2024-01-05", "2024-02-10"
_SCOPE = f"tenant_id = '{EVIDENCE_TENANT}' AND {{ts}} >= TIMESTAMP '{EVIDENCE_START}' AND {{ts}} < TIMESTAMP '{EVIDENCE_END}'"


@register("sc7_evidence_export", with_views("records", "escalations", "retrievals") + " UNION ALL ".join(f"""
SELECT '{name}' AS dataset, count(*) AS n_rows, CAST(sum({ident}) AS BIGINT) AS id_sum, 0 AS n_problems FROM {view} WHERE {_SCOPE.format(ts=ts)}
GROUP BY ALL HAVING count(*) > 0""" for name, view, ident, ts in (
    ("decision-log", "records", "decision_id", "ts"), ("escalation-log", "escalations", "decision_id", "requested_at"),
    ("retrieval-log", "retrievals", "event_id", "ts"))))
def sc7_evidence_export(spark, sf_dir):
    """A tenant's evidence written as JSON, read back and held against its manifest (no file may differ)."""
    sets = {"decision-log": (T.records(spark, sf_dir), "decision_id", "ts"),
            "escalation-log": (T.escalations(spark, sf_dir), "decision_id", "requested_at"),
            "retrieval-log": (T.retrievals(spark, sf_dir), "event_id", "ts")}
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evidence-{uuid.uuid4().hex}"
    manifest = sinks.export_evidence({n: s[0] for n, s in sets.items()}, root, EVIDENCE_TENANT, EVIDENCE_START, EVIDENCE_END,
                                     ts_cols={n: s[2] for n, s in sets.items()})
    name = F.element_at(F.split("path", "/"), -2)
    problems = sinks.verify_manifest(cut_lineage(manifest), [f"{root}/{n}" for n in sets]).groupBy(name.alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_problems"))
    rows = None
    for n, (df, ident, _) in sets.items():
        one = spark.read.schema(df.schema).json(f"{root}/{n}").select(F.lit(n).alias("dataset"), F.col(ident).alias("id"))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("id_sum"))
    return counts.join(problems, "dataset", "left").select(
        "dataset", "n_rows", "id_sum", F.coalesce("n_problems", F.lit(0)).cast("int").alias("n_problems"))
