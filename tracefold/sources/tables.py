"""Parquet table access and the stand-in views over the driver tables.

The driver data is a generic star schema plus ``events``, ``documents``,
``conversations``, ``labels`` and ``embeddings``. The views below only reshape
those rows into the schemas the telemetry jobs expect (records, texts, turns,
scores, attempts, retrievals, memories, escalations, reviews, vectors). They
do none of a job's work; every job runs unchanged on any data of that shape.
Each view has a DuckDB twin in ``tracefold.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.schemas import pack_attrs

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: tuple[str, ...], idx) -> F.Column:
    """``values[idx]`` for a non-negative integer column (element_at is 1-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat log records, one per event (columns as in FIXTURES.md section 2); some notes get an e-mail address or
    more than 8,192 bytes, which the events lack."""
    e = read_table(spark, sf_dir, "events")
    cls = (F.when(F.col("event_type").isin("view", "click"), "decision_summary")
            .when(F.col("event_type") == "purchase", "cost_usage_aggregate")
            .when(F.col("event_type") == "error", "escalation")
            .otherwise("unlisted_class"))
    return e.select(
        F.col("event_id").alias("decision_id"),
        "ts",
        "user_id",
        F.concat(F.lit("t-"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.concat(F.lit("a-"), (F.col("user_id") % 20).cast("string")).alias("agent_id"),
        cls.alias("event_class"),
        F.concat(F.lit("m-"), (F.col("event_id") % 4).cast("string")).alias("model"),
        (F.col("value") / 1000).cast("decimal(18,6)").alias("cost_usd"),
        F.floor("value").cast("bigint").alias("latency_ms"),
        (F.col("event_id") % 1000).alias("input_tokens"),
        (F.col("event_id") % 700).alias("output_tokens"),
        F.when(F.col("event_id") % 29 == 1, F.concat("props", F.lit(" mail user"), F.col("user_id").cast("string"), F.lit("@example.com ")))
         .when(F.col("event_id") % 29 == 2, F.repeat(F.lit("note "), 2000)).otherwise(F.col("props")).alias("internal_note"),
    )


RECORD_ATTR_SPEC = {
    "event_class": ("event_class", "str"),
    "tenant_id": ("tenant_id", "str"),
    "agent_id": ("agent_id", "str"),
    "decision_id": ("decision_id", "int"),
    "model": ("model", "str"),
    "cost_usd": ("cost_usd", "double"),
    "latency_ms": ("latency_ms", "int"),
    "input_tokens": ("input_tokens", "int"),
    "output_tokens": ("output_tokens", "int"),
    "internal_note": ("internal_note", "str"),
    "user_id": ("user_id", "int"),
}


def record_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the collector's log shape: ``(decision_id, ts, attrs)``."""
    r = records(spark, sf_dir)
    return pack_attrs(r, RECORD_ATTR_SPEC).select("decision_id", "ts", "attrs")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as callers hand them in: some with white space around them, some empty, blank or not there."""
    k = F.col("decision_id") % 19
    tenant, agent = F.col("tenant_id"), F.col("agent_id")
    return records(spark, sf_dir).select(
        "decision_id",
        F.when(k == 1, F.concat(F.lit("\u2003 "), tenant, F.lit("\t"))).when(k == 2, F.lit(" \n\u00a0")).when(k == 3, F.lit(""))
         .otherwise(tenant).alias("tenant_id"),
        F.when(k == 4, F.concat(agent, F.lit("  "))).when(k == 5, F.lit(None).cast("string")).otherwise(agent).alias("agent_id"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts; some get a jailbreak phrase, outer white space, a phone number or more than 64,000
    characters, which the documents themselves lack."""
    d = read_table(spark, sf_dir, "documents")
    t, k = F.col("text"), F.col("doc_id") % 23
    value = (F.when(k == 1, F.concat(t, F.lit(" " + C.JAILBREAK_PHRASES[0].upper())))
              .when(k == 2, F.concat(F.lit("\u2003  "), t, F.lit(" \t\n")))
              .when(k == 3, F.repeat(F.lit("long text "), 7000))
              .when(k == 4, F.concat(t, F.lit(" 415-555-0134"))).otherwise(t))
    return d.select("doc_id", F.lit("decision_summary.text").alias("path"), value.alias("value"), "lang", "source")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; some get a jailbreak phrase (also broken by a newline), an e-mail address that only
    the assistant writes, a phone number or outer white space."""
    c = read_table(spark, sf_dir, "conversations")
    t, k = F.col("text"), (F.col("conv_id") * 3 + F.col("turn")) % 17
    phrase = C.JAILBREAK_PHRASES[0]
    text = (F.when(k == 1, F.concat(t, F.lit("\n" + phrase.replace(" ", "\n", 1))))
             .when(k == 2, F.concat(t, F.lit(" " + phrase)))
             .when((k == 3) & (F.col("role") == "assistant"), F.concat(t, F.lit(" write to help.desk@example.org")))
             .when(k == 4, F.concat(t, F.lit(" 415-555-0134")))
             .when(k == 5, F.concat(F.lit("\u2003 "), t, F.lit("\n "))).otherwise(t))
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", text.alias("text"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge scores: one row per labelled document."""
    lab = read_table(spark, sf_dir, "labels")
    doc = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select(
        F.col("doc_id").alias("decision_id"),
        F.when(F.col("toxic") == 1, "harmlessness").otherwise("groundedness").alias("rubric"),
        ((F.col("doc_id") * 37 % 100).cast("decimal(9,0)") / 100).cast("decimal(9,2)").alias("score"),
        F.when(F.col("quality") == 1, "fast").otherwise("deep").alias("tier"),
        F.concat(F.lit("t-"), (F.col("doc_id") % 5).cast("string")).alias("tenant_id"),
        F.concat(F.lit("a-"), (F.col("doc_id") % 20).cast("string")).alias("agent_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") * 37).cast("int"))).alias("ts"),
        F.col("n_chars").alias("output_length"),
        "source",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("run-"), (F.col("doc_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("suite"),
        F.col("source").alias("probe"),
        F.col("doc_id").alias("attempt_id"),
        ((F.col("doc_id") * 7919 % 1000).cast("decimal(9,0)") / 1000).cast("decimal(9,3)").alias("score"),
        F.sha2(F.col("text"), 256).alias("prompt_hash"),
        (F.col("n_chars") % 997).alias("latency_ms"),
        F.col("text").alias("prompt"),
    )


ATTEMPT_SCORERS = ("refusal", "harm", "leak")


def attempt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several scorer results per attempt (three scorers, coarse scores)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    pos = F.explode(F.sequence(F.lit(0), F.lit(len(ATTEMPT_SCORERS) - 1))).alias("pos")
    x = d.select("doc_id", pos)
    return x.select(
        F.col("doc_id").alias("attempt_id"),
        F.col("pos").cast("bigint").alias("pos"),
        _pick(ATTEMPT_SCORERS, F.col("pos")).alias("scorer"),
        (((F.col("doc_id") * 31 + F.col("pos") * 17) % 10).cast("decimal(9,0)") / 10)
        .cast("decimal(9,1)").alias("score"),
    )


def retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    eid = F.col("event_id")
    src = F.when(eid % 13 == 0, F.lit("web")).otherwise(_pick(C.RETRIEVAL_SOURCES, eid % 7))
    qh = F.when(eid % 11 == 0, F.lit("not-a-hash")).otherwise(F.sha2((eid % 50).cast("string"), 256))
    return e.select(
        (eid - eid % 3).alias("decision_id"),
        eid.alias("event_id"),
        "ts",
        src.alias("source"),
        qh.alias("query_hash"),
        (eid % 6).alias("result_count"),
        F.when(eid % 4 == 0, eid % 5).alias("n_result_hashes"),
        F.concat(F.lit("t-"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    eid = F.col("event_id")
    return e.select(
        (eid - eid % 3).alias("decision_id"),
        eid.alias("event_id"),
        "ts",
        _pick(C.MEMORY_KINDS, F.col("user_id") % 3).alias("kind"),
        F.sha2(F.col("props"), 256).alias("content_hash"),
        F.when(eid % 2 == 0, (eid % 5 + 1) * 86400).alias("ttl_seconds"),
    )


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).filter(F.col("event_class") == "escalation")
    did = F.col("decision_id")
    return r.select(
        F.concat(F.lit("esc-"), did.cast("string")).alias("escalation_id"),
        did.alias("decision_id"),
        "tenant_id", "agent_id",
        F.col("ts").alias("requested_at"),
        (F.col("ts") + F.expr("INTERVAL 4 HOURS")).alias("deadline"),
        _pick(C.ESCALATION_MODES, did % 3).alias("mode"),
        _pick(C.FALLBACK_POLICIES, F.col("user_id") % 3).alias("fallback"),
        (did % 3 + 1).alias("required_rank"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict deliveries: every third escalation reviewed, every ninth gets a
    second, different verdict, every fifteenth the same verdict once more under
    another nonce, every eighteenth delivery comes twice, every 27th comes in
    eight days after it was given, and every 21st names no escalation."""
    esc = escalations(spark, sf_dir).filter(F.col("decision_id") % 3 == 0)
    did = F.col("decision_id")
    k = (did / 3).cast("bigint")
    base_at = F.col("requested_at") + F.make_dt_interval(F.lit(0), (did % 13).cast("int"))
    came = F.when(did % 27 == 0, F.expr("INTERVAL 8 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    base = esc.select(
        F.when(did % 21 == 0, F.concat(F.lit("none-"), did.cast("string"))).otherwise(F.col("escalation_id")).alias("escalation_id"),
        "decision_id",
        F.concat(F.lit("n-"), did.cast("string")).alias("nonce"),
        _pick(C.REVIEW_VERDICTS, k % 3).alias("verdict"),
        F.concat(F.lit("rev-"), (did % 7).cast("string")).alias("reviewer_id"),
        (k % 4).alias("reviewer_rank"),
        base_at.alias("reviewed_at"), (base_at + came).alias("received_at"),
    )
    second = esc.filter(did % 9 == 0).select(
        "escalation_id", "decision_id",
        F.concat(F.lit("n-"), did.cast("string"), F.lit("-b")).alias("nonce"),
        _pick(C.REVIEW_VERDICTS, (k + 1) % 3).alias("verdict"),
        F.concat(F.lit("rev-"), ((did + 1) % 7).cast("string")).alias("reviewer_id"),
        F.lit(3).cast("bigint").alias("reviewer_rank"),
        (base_at + F.expr("INTERVAL 1 HOURS")).alias("reviewed_at"),
        (base_at + F.expr("INTERVAL 1 HOURS")).alias("received_at"),
    )
    again = base.filter(did % 15 == 0).select(
        "escalation_id", "decision_id", F.concat("nonce", F.lit("-c")).alias("nonce"), "verdict", "reviewer_id", "reviewer_rank",
        (F.col("reviewed_at") + F.expr("INTERVAL 30 MINUTES")).alias("reviewed_at"),
        (F.col("reviewed_at") + F.expr("INTERVAL 30 MINUTES")).alias("received_at"))
    replay = base.filter(F.col("decision_id") % 18 == 0)
    return base.unionByName(second).unionByName(again).unionByName(replay)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def decision_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-decision outcome flags in the shape the status rule consumes."""
    r = records(spark, sf_dir)
    lat = F.col("latency_ms")
    return r.select(
        "decision_id", "tenant_id", "agent_id", "ts",
        (lat % 7 == 0).alias("blocked"),
        (F.col("event_class") == "escalation").alias("escalated"),
        F.when(lat % 11 == 0, F.lit("TimeoutError")).alias("exception"),
    )


def guard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guardrail/escalation outcome events, several per decision."""
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        (eid - eid % 3).alias("decision_id"), eid.alias("event_id"), "ts",
        (F.col("value") > 200).alias("blocked"),
        (F.col("event_type") == "error").alias("escalated"),
        F.concat(F.lit("rail:r"), (F.col("user_id") % 4).cast("string")).alias("policy"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer content fetches (one per 'view' event)."""
    e = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "view")
    return e.select(F.concat(F.lit("rev-"), (F.col("user_id") % 7).cast("string")).alias("reviewer_id"),
                    "ts", F.col("event_id").alias("fetch_id"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a delivery time later than their event time (0-599 s)."""
    e = read_table(spark, sf_dir, "events")
    delay = (F.col("event_id") * 7919 % 600).cast("int")
    return e.select("event_id", "ts", F.col("user_id"),
                    (F.col("ts") + F.make_dt_interval(secs=delay.cast("decimal(18,6)"))).alias("arrived_at"))


def turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span per turn (``schemas.SPANS`` shape) with namespaced and foreign
    attributes on the resource, the span and one span event."""
    from tracefold.schemas import ATTR_MAP, SPANS
    c = read_table(spark, sf_dir, "conversations")
    sysrole = F.col("role") == "system"
    base = c.select(
        "conv_id", "turn", "role", "text",
        F.lpad(F.lower(F.hex("conv_id")), 32, "0").alias("trace_id"),
        F.lpad(F.lower(F.hex(F.col("conv_id") * 1000 + F.col("turn"))), 16, "0").alias("span_id"),
        F.when(sysrole, F.lit(None).cast("bigint")).otherwise(F.col("conv_id")).alias("sid"),
        F.when(sysrole, F.lit(None).cast("string")).otherwise(F.col("role")).alias("role_ns"),
        F.when(sysrole, F.lit(None).cast("bigint")).otherwise(F.length("text").cast("bigint")).alias("chars"),
        F.concat(F.lit("agent-"), (F.col("conv_id") % 3).cast("string")).alias("svc"),
        F.concat(F.lit("h"), (F.col("conv_id") % 5).cast("string")).alias("host"),
        F.when(sysrole, F.lit(None).cast("string")).otherwise(
            F.when(F.col("role") == "user", "input").otherwise("output_final")).alias("phase"),
        F.lit("p-1").alias("pod"), F.lit("1").alias("spoof"))
    a = pack_attrs(base, {"decision.session_id": ("sid", "int"), "decision.role": ("role_ns", "str"),
                          "gen_ai.output_chars": ("chars", "int"), "user.text": ("text", "str"),
                          "decisionx.spoof": ("spoof", "str")}, out="attrs")
    a = pack_attrs(a, {"service.name": ("svc", "str"), "host.name": ("host", "str")}, out="resource_attrs")
    a = pack_attrs(a, {"decision.guardrail.phase": ("phase", "str"), "k8s.pod": ("pod", "str")}, out="ev_attrs")
    out = a.select(
        "trace_id", "span_id", F.lit(None).cast("string").alias("parent_span_id"),
        F.lit("decision.decision").alias("name"), F.lit(1).alias("kind"),
        (F.col("turn") * 1_000_000_000).alias("start_ns"), (F.col("turn") * 1_000_000_000 + 500).alias("end_ns"),
        F.lit(1).alias("status_code"), F.lit(None).cast("string").alias("status_message"),
        F.lit("decision.sdk").alias("scope_name"), F.col("resource_attrs").cast(ATTR_MAP),
        F.col("attrs").cast(ATTR_MAP),
        F.array(F.struct(F.lit("decision.guardrail").alias("name"), (F.col("turn") * 1_000_000_000 + 1).alias("time_ns"),
                         F.col("ev_attrs").alias("attrs"))).alias("events"))
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SPANS.fields])


def _any(kind: str, value) -> F.Column:
    """An OTLP value of one kind; integers travel as text."""
    return F.struct((value.cast("string") if kind == "intValue" else value).alias(kind))


def _kv(key: str, kind: str, value, when=None) -> F.Column:
    """``[{key, value}]`` as JSON text, or an empty list where there is nothing to tell."""
    entry = F.to_json(F.struct(F.lit(key).alias("key"), _any(kind, value).alias("value")))
    there = value.isNotNull() if when is None else value.isNotNull() & when
    return F.when(there, F.array(entry)).otherwise(F.array().cast("array<string>"))


def _list(*parts) -> F.Column:
    return F.concat(F.lit("["), F.array_join(F.concat(*parts), ","), F.lit("]"))


def _span_text(trace, span, parent, name, start, end, attrs, events=None, status=None) -> F.Column:
    """One span as OTLP/JSON text; ``attrs`` and ``events`` are JSON lists."""
    head = F.to_json(F.struct(trace.alias("traceId"), span.alias("spanId"), parent.alias("parentSpanId"), F.lit(name).alias("name"),
                              F.lit(1).alias("kind"), start.cast("string").alias("startTimeUnixNano"), end.cast("string").alias("endTimeUnixNano")))
    tail = [F.lit(',"attributes":'), attrs]
    if events is not None:
        tail += [F.lit(',"events":'), events]
    if status is not None:
        tail += [F.lit(',"status":'), status]
    return F.concat(F.left(head, F.length(head) - 1), *tail, F.lit("}"))


TRACE_START_NS = 1_704_067_200_000_000_000


def turn_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OTLP/JSON trace request per assistant turn: ``session_id, turn, body``.

    The decision span carries identity, lengths, events (retrievals, a memory write, a guardrail check, an escalation)
    and a status; an LLM call names its usage in one attribute namespace or the other, a tool call follows every second
    turn, and every 11th tool call has lost its parent.
    """
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    cid, turn = F.col("conv_id"), F.col("turn").cast("bigint")
    k = cid + turn
    trace = F.lpad(F.hex(cid), 32, "0")

    def sid(n: int):
        return F.lpad(F.lower(F.hex((cid * 1000 + turn) * 10 + n)), 16, "0")

    start = F.lit(TRACE_START_NS).cast("bigint") + turn * 60_000_000_000 + cid * 1_000_000
    end = start + (k % 900 + 1) * 1_000_000

    def event(name: str, after: int, attrs, when) -> F.Column:
        text = F.concat(F.lit('{"name":"' + name + '","timeUnixNano":"'), (start + after).cast("string"), F.lit('","attributes":'), attrs, F.lit("}"))
        return F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))

    yes = F.lit(True)
    events = _list(
        event("decision.retrieval", 1000, _list(_kv("decision.retrieval.source", "stringValue", _pick(C.RETRIEVAL_SOURCES, k % 7)),
                                                _kv("decision.retrieval.result_count", "intValue", k % 6)), k % 4 != 0),
        event("decision.retrieval", 2000, _list(_kv("decision.retrieval.source", "stringValue", _pick(C.RETRIEVAL_SOURCES, k % 3))), k % 2 == 0),
        event("decision.memory", 3000, _list(_kv("decision.memory.kind", "stringValue", _pick(C.MEMORY_KINDS, cid % 3))), k % 5 == 0),
        event("decision.guardrail", 4000, _list(
            _kv("decision.guardrail.phase", "stringValue", F.when(k % 2 == 0, "input").otherwise("output_final")),
            _kv("decision.guardrail.blocked", "boolValue", k % 6 == 0),
            _kv("decision.guardrail.pii_count", "intValue", k % 3, k % 3 != 0),
            _kv("decision.guardrail.policy", "stringValue", F.concat(F.lit("rail:r"), (k % 4).cast("string")))), k % 3 != 2),
        event("decision.guardrail", 5000, _list(
            _kv("decision.guardrail.phase", "stringValue", F.lit("output_final")),
            _kv("decision.guardrail.blocked", "boolValue", F.lit(False)),
            _kv("decision.guardrail.pii_count", "intValue", F.lit(1).cast("bigint"), yes)), k % 7 == 0),
        event("decision.escalation", 6000, F.lit("[]"), k % 10 == 0))
    chars = F.length("text").cast("bigint")
    attrs = _list(
        _kv("decision.tenant_id", "stringValue", F.concat(F.lit("t-"), (cid % 5).cast("string"))),
        _kv("decision.agent_id", "stringValue", F.concat(F.lit("a-"), (cid % 20).cast("string"))),
        _kv("decision.session_id", "stringValue", F.concat(F.lit("s"), cid.cast("string"))),
        _kv("decision.request_id", "stringValue", F.concat(F.lit("s"), cid.cast("string"), F.lit(":t"), turn.cast("string"))),
        _kv("decision.input_length", "intValue", chars % 500, k % 8 != 0),
        _kv("decision.output_length", "intValue", chars))
    llm = _list(
        _kv("gen_ai.request.model", "stringValue", F.concat(F.lit("m-"), (k % 4).cast("string")), k % 3 != 0),
        _kv("decision.llm.request.model", "stringValue", F.concat(F.lit("m-"), (k % 4 + 1).cast("string")), k % 3 != 1),
        _kv("gen_ai.usage.input_tokens", "intValue", chars % 300, k % 2 == 0),
        _kv("decision.llm.usage.input_tokens", "intValue", chars % 300 + 1),
        _kv("gen_ai.usage.output_tokens", "intValue", chars % 200 + 2),
        _kv("decision.llm.usage.output_tokens", "intValue", chars % 200))
    tool = _list(_kv("decision.tool.name", "stringValue", F.lit("search"), k % 4 == 1),
                 _kv("gen_ai.tool.name", "stringValue", F.lit("lookup"), k % 4 == 3),
                 _kv("decision.tool.result_count", "intValue", k % 9))
    status = F.when(k % 13 == 0, F.lit('{"code":2,"message":"TimeoutError"}')).otherwise(F.lit('{"code":1}'))
    none = F.lit("")
    spans = _list(
        F.array(_span_text(trace, sid(0), none, "decision.decision", start, end, attrs, events, status),
                _span_text(trace, sid(1), sid(0), "decision.llm_call", start + 10_000, end - 10_000, llm)),
        F.when(k % 2 == 1, F.array(_span_text(trace, sid(2), F.when(k % 11 == 0, sid(9)).otherwise(sid(0)), "decision.tool_call",
                                              start + 20_000, end - 20_000, tool))).otherwise(F.array().cast("array<string>")))
    body = F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":'),
                    _list(_kv("service.name", "stringValue", F.concat(F.lit("agent-"), (cid % 3).cast("string")))),
                    F.lit('},"scopeSpans":[{"scope":{"name":"decision.sdk"},"spans":'), spans, F.lit("}]}]}"))
    return c.select(cid.alias("session_id"), "turn", body.alias("body"))


def record_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OTLP/JSON log request per record: ``decision_id, body``; every 97th text is cut short."""
    r = records(spark, sf_dir)
    did = F.col("decision_id")
    attrs = _list(
        _kv("event_class", "stringValue", F.col("event_class")), _kv("tenant_id", "stringValue", F.col("tenant_id"), did % 17 != 0),
        _kv("agent_id", "stringValue", F.col("agent_id")), _kv("latency_ms", "intValue", F.col("latency_ms")),
        _kv("cost_usd", "doubleValue", F.col("cost_usd").cast("double")), _kv("cached", "boolValue", did % 2 == 0))
    body = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":'), _list(_kv("host.name", "stringValue", F.concat(F.lit("h"), (did % 5).cast("string")))),
        F.lit('},"scopeLogs":[{"scope":{"name":"decision.sdk"},"logRecords":[{"timeUnixNano":"'), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"),
        F.lit('","severityText":"INFO","body":{"stringValue":"'), did.cast("string"), F.lit('"},"attributes":'), attrs, F.lit("}]}]}]}"))
    return r.select("decision_id", F.when(did % 97 == 0, F.left(body, F.length(body) - 2)).otherwise(body).alias("body"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard events as delivered by an at-least-once bus: every fifth event is
    delivered a second time 30 seconds later (a replay)."""
    g = guard_events(spark, sf_dir).select("decision_id", "event_id", F.col("ts").alias("arrived_at"), "blocked")
    replay = g.filter(F.col("event_id") % 5 == 0).withColumn(
        "arrived_at", F.col("arrived_at") + F.expr("INTERVAL 30 SECONDS"))
    return g.unionByName(replay)
