"""Per-decision folds: span tree, decision summary and event roll-ups
(JN1, JN2, AG1-AG3, WN1, WN2).

Span events travel on the decision span's own row, so rolling them up is a
per-row array fold (no shuffle). Child spans (LLM and tool calls) are
separate rows; they are pre-aggregated per parent and joined on
``(trace_id, span_id)``, so the join side has one row per decision.
Grouped roll-ups over flat event tables only use mergeable aggregates
(count, bool_or, min_by, sets over closed vocabularies), so Spark combines
them map-side and a hot decision never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.contracts import coalesce_namespaces
from tracefold.schemas import attr_str


def _ns(ns: str, name: str) -> str:
    return f"{ns}.{name}"


# --------------------------------------------------------------------------- flat roll-ups
def retrieval_rollup(df: DataFrame, key: Sequence[str] = ("decision_id",), source_col: str = "source") -> DataFrame:
    """AG1: retrieval count and sorted distinct sources per decision.

    The source vocabulary is a closed enum, so the distinct set per decision
    is bounded by its size however many events a decision has.
    """
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("retrieval_count"),
        F.array_join(F.array_sort(F.collect_set(source_col)), ",").alias("retrieval_sources"))


def memory_rollup(df: DataFrame, key: Sequence[str] = ("decision_id",), kind_col: str = "kind") -> DataFrame:
    """AG2: memory-write count and sorted distinct kinds per decision."""
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("memory_write_count"),
        F.array_join(F.array_sort(F.collect_set(kind_col)), ",").alias("memory_kinds"))


def guardrail_rollup(df: DataFrame, key: Sequence[str], blocked_col: str = "blocked", entities_col: str = "entities",
                     policies_col: str = "policies", latency_col: str | None = None) -> DataFrame:
    """AG3: blocked-any, entity totals ``category:count``, distinct policies and, with ``latency_col``, the summed latency.

    One pass over the events: each gives a row per entity, of which the first also stands for the event (one without
    entities gives a row without a category). Rows are summed per (key, category), then folded per key, so ``df`` is
    computed once. Category and policy vocabularies are bounded by the rule set.
    """
    key = list(key)
    first = F.coalesce(F.col("__pos") == 0, F.lit(True))
    latency = F.col(latency_col) if latency_col else F.lit(None)
    each = df.select(*key, F.col(blocked_col).alias("__blocked"), F.col(policies_col).alias("__policies"), latency.cast("bigint").alias("__latency"),
                     F.posexplode_outer(entities_col).alias("__pos", "__entity"))
    parts = F.split("__entity", ":")
    by_category = each.groupBy(*key, F.get(parts, F.lit(0)).alias("__category")).agg(
        F.count_if(first).alias("__events"), F.bool_or("__blocked").alias("__blocked"),
        F.collect_set(F.when(first, F.col("__policies"))).alias("__policies"), F.sum(F.when(first, F.col("__latency"))).alias("__latency"),
        F.sum(F.get(parts, F.lit(1)).cast("bigint")).alias("__n"))
    total = F.when(F.col("__category").isNotNull(), F.concat("__category", F.lit(":"), F.col("__n").cast("string")))
    return by_category.groupBy(*key).agg(
        F.sum("__events").alias("guardrail_events"), F.bool_or("__blocked").alias("blocked"),
        F.array_join(F.array_sort(F.collect_list(total)), ",").alias("entities"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.flatten(F.collect_list("__policies"))))), ",").alias("policies"),
        *([F.sum("__latency").alias("latency_ms")] if latency_col else []))


def first_wins(df: DataFrame, key: Sequence[str], flag: Column | None, order: Sequence[str],
               id_col: str, prefix: str) -> DataFrame:
    """WN1/WN2: the earliest flagged event per decision is canonical; every
    later flagged event is a violation.

    ``min_by`` over the ``order`` struct is a mergeable aggregate (ties
    broken by the trailing order columns), so no window sorts a whole group.
    """
    src = df if flag is None else df.filter(flag)
    o = F.struct(*[F.col(c) for c in order])
    return src.groupBy(*key).agg(
        F.min_by(F.col(id_col), o).alias(f"{prefix}_{id_col}"),
        F.min(o)[order[0]].alias(f"{prefix}_{order[0]}"),
        (F.count(F.lit(1)) - 1).alias("violations"))


# --------------------------------------------------------------------------- span folds
def _events_named(events: Column, name: str) -> Column:
    return F.filter(events, lambda e: e["name"] == name)


def summarize_decision_spans(spans: DataFrame, ns: str = "decision") -> DataFrame:
    """JN2 (span part): one row per decision span with rolled-up events.

    Retrieval/memory/guardrail/escalation events are folded from the span's
    own event array; identity and text lengths come from the span attributes
    (null where unset). ``pii_detected_count`` sums the guardrail events' counts;
    ``guardrail_actions`` has one ``phase:action:policy`` per guardrail event in time
    order (action ``block``, ``redact`` where PII was found, else ``pass``).
    """
    d = spans.filter(F.col("name") == _ns(ns, "decision"))
    ev = F.col("events")
    retr = _events_named(ev, _ns(ns, "retrieval"))
    mem = _events_named(ev, _ns(ns, "memory"))
    guard = _events_named(ev, _ns(ns, "guardrail"))
    esc = _events_named(ev, _ns(ns, "escalation"))
    a = F.col("attrs")

    def blocked(e: Column) -> Column:
        return F.coalesce(e["attrs"][_ns(ns, "guardrail.blocked")]["b"], F.lit(False))

    def pii(e: Column) -> Column:
        return F.coalesce(e["attrs"][_ns(ns, "guardrail.pii_count")]["i"], F.lit(0).cast("bigint"))

    def action(e: Column) -> Column:
        kind = F.when(blocked(e), "block").when(pii(e) > 0, "redact").otherwise("pass")
        return F.concat_ws(":", e["attrs"][_ns(ns, "guardrail.phase")]["s"], kind, e["attrs"][_ns(ns, "guardrail.policy")]["s"])

    actions = F.array_sort(F.transform(guard, lambda e: F.struct(e["time_ns"].alias("t"), action(e).alias("a"))))
    return d.select(
        "trace_id", "span_id",
        attr_str(a, _ns(ns, "tenant_id")).alias("tenant_id"),
        attr_str(a, _ns(ns, "agent_id")).alias("agent_id"),
        attr_str(a, _ns(ns, "session_id")).alias("session_id"),
        attr_str(a, _ns(ns, "request_id")).alias("request_id"),
        "start_ns", "end_ns",
        ((F.col("end_ns") - F.col("start_ns")) / F.lit(1_000_000)).cast("bigint").alias("latency_ms"),
        F.size(retr).alias("retrieval_count"),
        F.array_sort(F.array_distinct(F.transform(retr, lambda e: e["attrs"][_ns(ns, "retrieval.source")]["s"])))
        .alias("retrieval_sources"),
        F.size(mem).alias("memory_write_count"),
        F.array_sort(F.array_distinct(F.transform(mem, lambda e: e["attrs"][_ns(ns, "memory.kind")]["s"])))
        .alias("memory_kinds"),
        F.exists(guard, blocked).alias("blocked"),
        a[_ns(ns, "input_length")]["i"].alias("input_length"),
        a[_ns(ns, "output_length")]["i"].alias("output_length"),
        F.aggregate(guard, F.lit(0).cast("bigint"), lambda acc, e: acc + pii(e)).alias("pii_detected_count"),
        F.transform(actions, lambda x: x["a"]).alias("guardrail_actions"),
        F.size(esc).alias("escalation_events"),
        F.col("status_code"), F.col("status_message"),
    )


#: Fields of a call: name, kind, key of the common conventions, key below the governance prefix.
CALL_FIELDS = (
    ("system", "str", "gen_ai.system", "llm.system"),
    ("model", "str", "gen_ai.request.model", "llm.request.model"),
    ("response_model", "str", "gen_ai.response.model", "llm.response.model"),
    ("temperature", "double", "gen_ai.request.temperature", "llm.request.temperature"),
    ("top_p", "double", "gen_ai.request.top_p", "llm.request.top_p"),
    ("max_tokens", "int", "gen_ai.request.max_tokens", "llm.request.max_tokens"),
    ("finish_reasons", "json", "gen_ai.response.finish_reasons", "llm.response.finish_reasons"),
    ("input_tokens", "int", "gen_ai.usage.input_tokens", "llm.usage.input_tokens"),
    ("output_tokens", "int", "gen_ai.usage.output_tokens", "llm.usage.output_tokens"),
    ("tool_name", "str", "gen_ai.tool.name", "tool.name"),
    ("tool_call_id", "str", "gen_ai.tool.call.id", "tool.call.id"),
)


def call_rows(spans: DataFrame, ns: str = "decision") -> DataFrame:
    """GT20: one typed row per LLM or tool call span, each field from either namespace (the common one first).

    A field that neither namespace sets is null; ``result_count`` is only told below the governance prefix.
    """
    llm, tool = _ns(ns, "llm_call"), _ns(ns, "tool_call")
    a = F.col("attrs")
    fields = coalesce_namespaces(a, [(out, kind, common, _ns(ns, own)) for out, kind, common, own in CALL_FIELDS])
    return spans.filter(F.col("name").isin(llm, tool)).select(
        "trace_id", "span_id", "parent_span_id", F.when(F.col("name") == llm, "llm").otherwise("tool").alias("call"),
        ((F.col("end_ns") - F.col("start_ns")) / F.lit(1_000_000)).cast("bigint").alias("latency_ms"),
        *fields, a[_ns(ns, "tool.result_count")]["i"].alias("result_count"))


def child_call_rollup(spans: DataFrame, ns: str = "decision") -> DataFrame:
    """JN1: LLM and tool child spans pre-aggregated per parent span (call rows from either namespace, GT20)."""
    kids = call_rows(spans, ns).filter(F.col("parent_span_id").isNotNull())
    is_llm = F.col("call") == "llm"
    return kids.groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(
        F.count_if(is_llm).alias("llm_calls"),
        F.count_if(~is_llm).alias("tool_calls"),
        F.sum(F.when(is_llm, F.col("input_tokens"))).cast("bigint").alias("input_tokens"),
        F.sum(F.when(is_llm, F.col("output_tokens"))).cast("bigint").alias("output_tokens"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_llm, F.col("model")))), ",").alias("models"))


def decision_summary(spans: DataFrame, ns: str = "decision") -> DataFrame:
    """JN2: decision rows with event roll-ups and child-call usage attached."""
    d = summarize_decision_spans(spans, ns)
    kids = child_call_rollup(spans, ns)
    j = d.join(kids, ["trace_id", "span_id"], "left")
    return j.select(*d.columns,
                    F.coalesce("llm_calls", F.lit(0)).alias("llm_calls"),
                    F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
                    F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
                    F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
                    F.coalesce("models", F.lit("")).alias("models"))


def span_tree(spans: DataFrame, ns: str = "decision") -> DataFrame:
    """JN1: child spans with their parent decision's identity (equi-join on
    ``(trace_id, parent_span_id = span_id)``)."""
    parents = spans.filter(F.col("name") == _ns(ns, "decision")).select(
        "trace_id", F.col("span_id").alias("decision_span_id"),
        attr_str(F.col("attrs"), _ns(ns, "tenant_id")).alias("tenant_id"),
        attr_str(F.col("attrs"), _ns(ns, "agent_id")).alias("agent_id"))
    kids = spans.filter(F.col("name") != _ns(ns, "decision")).select(
        "trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns")
    return kids.join(parents, (kids.trace_id == parents.trace_id) & (kids.parent_span_id == parents.decision_span_id)
                     ).drop(parents.trace_id)


def decision_summary_flat(decisions: DataFrame, retrievals: DataFrame, memories: DataFrame,
                          guard_events: DataFrame, scores: DataFrame, key: str = "decision_id") -> DataFrame:
    """JN2 over flat child tables: one row per decision with retrieval and
    memory roll-ups, guardrail outcome and judge scores.

    Each child table is reduced to one row per decision first, so every join
    is one-to-one on the decision key (no fan-out, no hot join side).
    """
    r = retrieval_rollup(retrievals, [key])
    m = memory_rollup(memories, [key])
    g = guard_events.groupBy(key).agg(F.count(F.lit(1)).alias("guardrail_events"),
                                      F.bool_or("blocked").alias("blocked"),
                                      F.bool_or("escalated").alias("escalated"))
    s = judge_score_labels(scores, key)
    j = decisions.join(r, key, "left").join(m, key, "left").join(g, key, "left").join(s, key, "left")
    return j.select(
        *decisions.columns,
        F.coalesce("retrieval_count", F.lit(0)).alias("retrieval_count"),
        F.coalesce("retrieval_sources", F.lit("")).alias("retrieval_sources"),
        F.coalesce("memory_write_count", F.lit(0)).alias("memory_write_count"),
        F.coalesce("memory_kinds", F.lit("")).alias("memory_kinds"),
        F.coalesce("guardrail_events", F.lit(0)).alias("guardrail_events"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        F.coalesce("escalated", F.lit(False)).alias("escalated"),
        F.coalesce("judge_scores", F.lit("")).alias("judge_scores"))


def judge_score_labels(scores: DataFrame, key: str = "decision_id", rubric_col: str = "rubric",
                       score_col: str = "score") -> DataFrame:
    """``rubric=score`` labels per decision, sorted, one per rubric (the lowest
    score of that rubric). Reducing to (decision, rubric) first bounds the
    list by the rubric vocabulary, however many scores a decision collects."""
    per = scores.groupBy(key, rubric_col).agg(F.min(score_col).alias("__s"))
    return per.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.col(rubric_col), F.lit("="), F.col("__s").cast("string")))), ",").alias("judge_scores"))
