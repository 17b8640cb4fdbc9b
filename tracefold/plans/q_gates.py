"""Registered gate jobs (GT1, GT3-GT5, GT8, GT9-GT12) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.operators import accounting, gate_pipeline, gates, policy, sampling
from tracefold.plans.oracle_views import with_views
from tracefold.plans.q_text import TENANT_KEY
from tracefold.plans.registry import register, sql_list
from tracefold.plans.sqlfrag import allowlist_values, hmac_sql, keep_sql, pii_cat_sql, sampler_keep_sql, strip_sql
from tracefold.schemas import attr_str, explode_attrs, pack_attrs
from tracefold.sources import tables as T

SAMPLER_KEY = b"tracefold-sampler-demo-key"
SAMPLER_RATES = {"decision_summary": 0.3, "cost_usage_aggregate": 0.5, "escalation": 1.0}


# --------------------------------------------------------------------------- GT1
@register("gt1_class_allowlist", with_views("record_attrs") + f"""
SELECT ra.decision_id, ra.key, ra.vtype, ra.vstr, ra.vint, ra.vdbl
FROM record_attrs ra JOIN {allowlist_values()} ON ra.event_class = al.event_class AND ra.key = al.key
WHERE NOT (ra.vtype = 'str' AND strlen(ra.vstr) > {C.DEFAULT_MAX_FIELD_BYTES})""")
def gt1_class_allowlist(spark, sf_dir):
    """Allowlisted attributes of every record, in row form."""
    g = gates.guard_records(T.record_attrs(spark, sf_dir))
    return explode_attrs(g, ["decision_id"]).drop("vbool")


# --------------------------------------------------------------------------- GT3
_KNOWN = sql_list(C.CLASS_ALLOWLIST)


@register("gt3_unknown_class", with_views("record_attrs", extra=(("kept", f"""
SELECT ra.decision_id, ra.event_class FROM record_attrs ra
JOIN {allowlist_values()} ON ra.event_class = al.event_class AND ra.key = al.key"""),)) + f"""
SELECT 'drop' AS mode, event_class, count(DISTINCT decision_id) AS n_records, count(*) AS n_attrs
FROM kept GROUP BY event_class
UNION ALL
SELECT 'pass', event_class, count(DISTINCT decision_id), count(*) FROM kept GROUP BY event_class
UNION ALL
SELECT 'pass', event_class, count(DISTINCT decision_id), count(*) FROM record_attrs
WHERE event_class NOT IN {_KNOWN} GROUP BY event_class""")
def gt3_unknown_class(spark, sf_dir):
    """Records and attributes per class after the guard, dropping vs passing unknown classes."""
    ra = T.record_attrs(spark, sf_dir)
    outs = []
    for mode, drop in (("drop", True), ("pass", False)):
        g = gates.guard_records(ra, drop_unknown=drop)
        outs.append(g.groupBy(attr_str("attrs", "event_class").alias("event_class")).agg(
            F.count(F.lit(1)).alias("n_records"), F.sum(F.size("attrs")).cast("bigint").alias("n_attrs"))
            .select(F.lit(mode).alias("mode"), "event_class", "n_records", "n_attrs"))
    return outs[0].unionByName(outs[1])


# --------------------------------------------------------------------------- GT4 / GT5
def _text_records(spark, sf_dir, class_key: str):
    t = T.texts(spark, sf_dir).withColumn("cls", F.lit("decision_summary"))
    return pack_attrs(t, {class_key: ("cls", "str"), "text": ("value", "str"), "lang": ("lang", "str")})


@register("gt4_oversized_strings", with_views("texts") + f"""
SELECT doc_id, strlen(value) <= {C.DEFAULT_MAX_FIELD_BYTES} AS has_text,
       CAST(1 + CASE WHEN strlen(value) <= {C.DEFAULT_MAX_FIELD_BYTES} THEN 1 ELSE 0 END AS INTEGER) AS n_attrs
FROM texts""")
def gt4_oversized_strings(spark, sf_dir):
    """Texts as records with a tenant-extra ``text`` field; values over 8,192 bytes are removed."""
    g = gates.guard_records(_text_records(spark, sf_dir, "event_class"), extra={"decision_summary": ["text"]})
    return g.select("doc_id", F.map_contains_key("attrs", "text").alias("has_text"),
                    F.size("attrs").alias("n_attrs"))


@register("gt5_empty_record_drop", with_views("texts") + f"""
SELECT doc_id, CAST(1 AS INTEGER) AS n_attrs FROM texts WHERE strlen(value) <= {C.DEFAULT_MAX_FIELD_BYTES}""")
def gt5_empty_record_drop(spark, sf_dir):
    """Class read from ``kind`` (not itself allowlisted): records left empty are dropped."""
    g = gates.guard_records(_text_records(spark, sf_dir, "kind"), extra={"decision_summary": ["text"]},
                            class_attr="kind")
    return g.select("doc_id", F.size("attrs").alias("n_attrs"))


# --------------------------------------------------------------------------- GT8
NOTES_ALLOWED = {"decision_summary": ["internal_note"]}


@register("gt8_strip_counters", with_views("record_attrs", extra=(("flags", f"""
SELECT ra.decision_id, ra.event_class, al.key IS NULL AS stripped,
       al.key IS NOT NULL AND ra.vtype = 'str' AND strlen(ra.vstr) > {C.DEFAULT_MAX_FIELD_BYTES} AS oversized
FROM record_attrs ra LEFT JOIN {allowlist_values(NOTES_ALLOWED)} ON ra.event_class = al.event_class AND ra.key = al.key"""),
    ("per", f"""
SELECT decision_id, event_class, event_class IN {_KNOWN} AS known,
       count(*) FILTER (WHERE stripped) AS stripped, count(*) FILTER (WHERE oversized) AS oversized, count(*) AS n
FROM flags GROUP BY decision_id, event_class"""))) + """
SELECT event_class, count(*) AS n_records,
       CAST(sum(CASE WHEN known THEN stripped ELSE 0 END) AS BIGINT) AS n_stripped,
       CAST(sum(CASE WHEN known THEN oversized ELSE 0 END) AS BIGINT) AS n_oversized,
       count(*) FILTER (WHERE NOT known OR n - stripped - oversized = 0) AS n_dropped
FROM per GROUP BY event_class""")
def gt8_strip_counters(spark, sf_dir):
    """Batch totals by class; a tenant adds its notes to one class, and some of them are too long."""
    return gates.strip_counters(T.record_attrs(spark, sf_dir), extra=NOTES_ALLOWED)


# --------------------------------------------------------------------------- GT9 / GT10
POLICY_RULE = "event_class <> 'escalation' AND latency_ms / (input_tokens % 7) > 20"


@register("gt9_policy_gate", with_views("records") + """
SELECT decision_id, event_class, tenant_id FROM records
WHERE event_class <> 'escalation' AND latency_ms / NULLIF(input_tokens % 7, 0) > 20""")
def gt9_policy_gate(spark, sf_dir):
    """SQL predicate gate; a division by zero drops the record (fail closed)."""
    r = T.records(spark, sf_dir)
    return policy.policy_gate(r, POLICY_RULE).select("decision_id", "event_class", "tenant_id")


# An overflow for every 50th record, a bad cast for every record but the numeric models, an index out of bounds for short
# notes, an error that the rule itself raises; and errors behind branches that are not taken.
USER_RULE = """CASE WHEN event_class = 'escalation' THEN raise_error('no escalations here')
     WHEN decision_id % 50 = 7 THEN 9223372036854775807 - latency_ms + decision_id > 0
     WHEN decision_id % 3 = 0 THEN coalesce(CAST(substring(model, 3, 1 + CAST(decision_id % 2 AS INT)) AS INT) < 2, true)
     WHEN decision_id % 3 = 1 THEN split(internal_note, ' ')[3] IS NULL OR latency_ms > 30
     ELSE input_tokens % 7 = 0 OR latency_ms / (input_tokens % 7) > 20 END"""


@register("ud4_policy_rule", with_views("records") + """
SELECT decision_id, event_class FROM records
WHERE CASE WHEN event_class = 'escalation' THEN FALSE
     WHEN decision_id % 50 = 7 THEN decision_id <= latency_ms
     WHEN decision_id % 3 = 0 THEN coalesce(CAST(substring(model, 3, 1 + CAST(decision_id % 2 AS INTEGER)) AS INTEGER) < 2, TRUE)
     WHEN decision_id % 3 = 1 THEN len(string_split(internal_note, ' ')) >= 4 AND latency_ms > 30
     ELSE input_tokens % 7 = 0 OR latency_ms / NULLIF(input_tokens % 7, 0) > 20 END""")
def ud4_policy_rule(spark, sf_dir):
    """A user's rule whose errors drop the record in which they happen, and no other."""
    return policy.policy_gate(T.records(spark, sf_dir), USER_RULE).select("decision_id", "event_class")


DENY_AGENTS = ["a-3", "a-7"]
ALLOW_TENANTS = ["t-0", "t-1", "t-2", "t-3"]
DROP_PATTERN = '"k": 1[0-9]}'


@register("gt10_policy_rules", with_views("records") + f"""
SELECT decision_id, tenant_id, agent_id FROM records
WHERE agent_id NOT IN {sql_list(DENY_AGENTS)} AND tenant_id IN {sql_list(ALLOW_TENANTS)}
  AND NOT regexp_matches(internal_note, '{DROP_PATTERN}')""")
def gt10_policy_rules(spark, sf_dir):
    rules = policy.RuleSet(deny={"agent_id": DENY_AGENTS}, allow={"tenant_id": ALLOW_TENANTS},
                           drop_patterns={"internal_note": DROP_PATTERN})
    return policy.apply_rules(T.records(spark, sf_dir), rules).select("decision_id", "tenant_id", "agent_id")


# --------------------------------------------------------------------------- GT11
@register("gt11_keyed_sampler", with_views("records") + f"""
SELECT decision_id, event_class, tenant_id, agent_id FROM records
WHERE {sampler_keep_sql('event_class', 'tenant_id', 'agent_id', SAMPLER_KEY, SAMPLER_RATES, 1.0)}""")
def gt11_keyed_sampler(spark, sf_dir):
    r = T.records(spark, sf_dir)
    return sampling.sample_records(r, SAMPLER_KEY, SAMPLER_RATES).select(
        "decision_id", "event_class", "tenant_id", "agent_id")


# --------------------------------------------------------------------------- GT12
_GT12_RATES = {"escalation": 1.0, "decision_summary": 0.1, "cost_usage_aggregate": 1.0}


def _gt12_rate_sql() -> str:
    return ("CASE WHEN event_class = 'escalation' THEN 1.0 WHEN latency_ms >= 300 THEN 1.0 "
            "WHEN event_class = 'decision_summary' THEN 0.1 ELSE 0.05 END")


def _gt12_keep_sql() -> str:
    msg = "coalesce(tenant_id, '') || '|' || coalesce(CAST(decision_id AS VARCHAR), '')"
    bucket = f"substr({hmac_sql(msg, SAMPLER_KEY)}, 1, 16)"
    return ("CASE " + " ".join(f"WHEN sample_rate = {r} THEN {keep_sql(r, bucket)}" for r in (0.05, 0.1, 1.0))
            + " ELSE FALSE END")


@register("gt12_conditional_sampler", with_views("records", extra=(("r", f"""
SELECT decision_id, tenant_id, event_class, {_gt12_rate_sql()} AS sample_rate FROM records"""),)) + f"""
SELECT decision_id, tenant_id, event_class, CAST(sample_rate AS DOUBLE) AS sample_rate FROM r WHERE {_gt12_keep_sql()}""")
def gt12_conditional_sampler(spark, sf_dir):
    """Escalations and slow decisions always kept, other summaries 10 %, the rest 5 %."""
    r = T.records(spark, sf_dir)
    rate = (F.when(F.col("event_class") == "escalation", F.lit(1.0))
             .when(F.col("latency_ms") >= 300, F.lit(1.0))
             .when(F.col("event_class") == "decision_summary", F.lit(0.1))
             .otherwise(F.lit(0.05)))
    out = sampling.conditional_sample(r, rate, SAMPLER_KEY)
    return out.select("decision_id", "tenant_id", "event_class", "sample_rate")


# --------------------------------------------------------------------------- AG7
@register("ag7_usage_hourly", with_views("records") + """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       tenant_id, agent_id, model, count(*) AS request_count,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(cost_usd) AS DOUBLE) AS cost_usd
FROM records GROUP BY ALL""")
def ag7_usage_hourly(spark, sf_dir):
    return accounting.usage_by_window(T.records(spark, sf_dir), "1 hour")


# --------------------------------------------------------------------------- flagship
def gated_usage(spark, sf_dir):
    """Minimum slice: records -> class allowlist -> keyed sampler -> hourly usage.

    Usage is summed only from attributes that survive the gate, so stripped
    token and cost fields never reach the aggregate. The typed gate keeps the
    whole map side (scan, gate, HMAC bucket, partial aggregate) in codegen.
    """
    attrs = [k for k in T.RECORD_ATTR_SPEC]
    g = gates.guard_typed(T.records(spark, sf_dir), attrs)
    s = sampling.sample_records(g, SAMPLER_KEY, SAMPLER_RATES)
    return accounting.usage_by_window(s, "1 hour", keys=("tenant_id", "agent_id", "event_class", "model"))


@register("gated_usage_hourly", with_views("records", extra=(("g", f"""
SELECT ts, event_class, tenant_id, agent_id,
       CASE WHEN event_class IN ('decision_summary', 'cost_usage_aggregate') THEN model END AS model,
       CASE WHEN event_class = 'cost_usage_aggregate' THEN input_tokens END AS input_tokens,
       CASE WHEN event_class = 'cost_usage_aggregate' THEN output_tokens END AS output_tokens,
       CASE WHEN event_class IN ('decision_summary', 'cost_usage_aggregate') THEN cost_usd END AS cost_usd
FROM records WHERE event_class IN {_KNOWN}
  AND {sampler_keep_sql('event_class', 'tenant_id', 'agent_id', SAMPLER_KEY, SAMPLER_RATES, 1.0)}"""),)) + """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       tenant_id, agent_id, event_class, model, count(*) AS request_count,
       CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(cost_usd) AS DOUBLE) AS cost_usd
FROM g GROUP BY ALL""")
def gated_usage_hourly(spark, sf_dir):
    return gated_usage(spark, sf_dir)


# --------------------------------------------------------------------------- the stages in deployed order (SM1, SC5, AG8, AG9)
GATE_RULE = "event_class <> 'decision_summary' OR latency_ms < 60"
GATE_EXTRA = {"decision_summary": ["internal_note"]}
GATE_SKIP = ("tenant_id", "agent_id", "model")


def gate_args() -> dict:
    """Settings of the gate that the registered pipeline jobs share."""
    return {"attr_cols": [c for c in T.RECORD_ATTR_SPEC if c not in ("decision_id", "user_id")], "rates": SAMPLER_RATES,
            "predicate": GATE_RULE, "redact_key": TENANT_KEY, "skip": GATE_SKIP, "extra": GATE_EXTRA}


#: Every record as the stages leave it, with the first stage that drops it; the record's own latency stays beside it.
STAGED_SQL = f"""
SELECT *, CASE WHEN event_class NOT IN {_KNOWN} THEN 'schema'
  WHEN coalesce(length({strip_sql('note')}) > {C.REDACT_MAX_VALUE_CHARS}, FALSE) THEN 'redaction'
  WHEN NOT coalesce(event_class <> 'decision_summary' OR gated_latency_ms < 60, FALSE) THEN 'policy'
  WHEN NOT {sampler_keep_sql('event_class', 'tenant_id', 'agent_id', SAMPLER_KEY, SAMPLER_RATES, 1.0)} THEN 'sampler' END AS drop_reason
FROM (SELECT decision_id, ts, event_class, tenant_id, agent_id, latency_ms, note,
             CASE WHEN event_class = 'decision_summary' THEN latency_ms END AS gated_latency_ms,
             CASE WHEN event_class = 'cost_usage_aggregate' THEN input_tokens END AS input_tokens,
             oversized, {pii_cat_sql(strip_sql('note'))} AS category, category IS NOT NULL AS hashed
      FROM (SELECT *, event_class = 'decision_summary' AND strlen(internal_note) > {C.DEFAULT_MAX_FIELD_BYTES} AS oversized,
                   CASE WHEN event_class = 'decision_summary' AND strlen(internal_note) <= {C.DEFAULT_MAX_FIELD_BYTES} THEN internal_note END AS note
            FROM records))"""


def staged_records(spark, sf_dir):
    """Every record with the first stage that drops it; ``observed_ms`` is its latency before the stages."""
    rec = T.records(spark, sf_dir).withColumn("observed_ms", F.col("latency_ms"))
    return gate_pipeline.staged(rec, sampler_key=SAMPLER_KEY, **gate_args())
