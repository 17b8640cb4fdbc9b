"""Registered contract and label jobs (GT18, GT19, GT21, GT22, GT25, GT26, FN5, FN6, FN8, FN10, FN11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions import labels
from tracefold.operators import contracts, policy
from tracefold.plans.oracle_views import with_views
from tracefold.plans.registry import register, sql_list
from tracefold.plans.sqlfrag import strip_sql
from tracefold.schemas import pack_attrs
from tracefold.sources import tables as T


# --------------------------------------------------------------------------- GT18
@register("gt18_record_contract", with_views("retrievals") + f"""
SELECT decision_id, event_id, reasons = '' AS valid, reasons FROM (
  SELECT decision_id, event_id, concat_ws(',',
    CASE WHEN decision_id IS NULL THEN 'missing_decision_id' END,
    CASE WHEN NOT coalesce(source IN {sql_list(C.RETRIEVAL_SOURCES)}, FALSE) THEN 'bad_source' END,
    CASE WHEN NOT coalesce(regexp_matches(query_hash, '{C.SHA256_HEX_PATTERN}'), FALSE) THEN 'bad_query_hash' END,
    CASE WHEN result_count < 0 THEN 'negative_result_count' END,
    CASE WHEN n_result_hashes IS NOT NULL AND n_result_hashes <> result_count THEN 'result_hash_count_mismatch' END
  ) AS reasons FROM retrievals)""")
def gt18_record_contract(spark, sf_dir):
    r = T.retrievals(spark, sf_dir)
    v = contracts.with_reasons(r, contracts.retrieval_rules(r))
    return v.select("decision_id", "event_id", "valid", F.array_join("reasons", ",").alias("reasons"))


@register("gt18_memory_contract", with_views("memories", extra=(("m", """
SELECT CASE WHEN event_id % 17 <> 0 THEN decision_id END AS decision_id, event_id, CASE event_id % 13 WHEN 1 THEN 'core' WHEN 2 THEN NULL ELSE kind END AS kind,
       CASE WHEN event_id % 11 = 0 THEN upper(content_hash) ELSE content_hash END AS content_hash,
       CASE WHEN event_id % 7 = 0 THEN -1 ELSE ttl_seconds END AS ttl_seconds FROM memories"""),)) + f"""
SELECT decision_id, event_id, reasons = '' AS valid, reasons FROM (
  SELECT decision_id, event_id, concat_ws(',',
    CASE WHEN decision_id IS NULL THEN 'missing_decision_id' END,
    CASE WHEN NOT coalesce(kind IN {sql_list(C.MEMORY_KINDS)}, FALSE) THEN 'bad_kind' END,
    CASE WHEN NOT coalesce(regexp_matches(content_hash, '{C.SHA256_HEX_PATTERN}'), FALSE) THEN 'bad_content_hash' END,
    CASE WHEN ttl_seconds < 0 THEN 'negative_ttl' END) AS reasons FROM m)""")
def gt18_memory_contract(spark, sf_dir):
    """Memory writes against their contract; some lack a decision or carry an unknown kind, a bad hash or a negative time to live."""
    k = F.col("event_id")
    m = T.memories(spark, sf_dir).withColumns({
        "decision_id": F.when(k % 17 != 0, F.col("decision_id")),
        "kind": F.when(k % 13 == 1, "core").when(k % 13 != 2, F.col("kind")),
        "content_hash": F.when(k % 11 == 0, F.upper("content_hash")).otherwise(F.col("content_hash")),
        "ttl_seconds": F.when(k % 7 == 0, -1).otherwise(F.col("ttl_seconds"))})
    v = contracts.with_reasons(m, contracts.memory_rules())
    return v.select("decision_id", "event_id", "valid", F.array_join("reasons", ",").alias("reasons"))


@register("gt18_escalation_contract", with_views("escalations", extra=(("e", f"""
SELECT escalation_id, CASE decision_id % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN repeat('r', {C.REASON_MAX_CHARS}) WHEN 3 THEN repeat('r', {C.REASON_MAX_CHARS + 1})
       ELSE 'low score' END AS reason, CASE WHEN decision_id % 5 = 0 THEN 'later' ELSE mode END AS mode FROM escalations"""),)) + f"""
SELECT escalation_id, reasons = '' AS valid, reasons FROM (
  SELECT escalation_id, concat_ws(',',
    CASE WHEN coalesce(length(reason) < {C.REASON_MIN_CHARS} OR length(reason) > {C.REASON_MAX_CHARS}, TRUE) THEN 'bad_reason_length' END,
    CASE WHEN NOT coalesce(mode IN {sql_list(C.ESCALATION_MODES)}, FALSE) THEN 'bad_mode' END) AS reasons FROM e)""")
def gt18_escalation_contract(spark, sf_dir):
    """Escalation requests against their contract; reasons may be empty, missing or a character too long, modes unknown."""
    k = F.col("decision_id")
    e = T.escalations(spark, sf_dir).withColumns({
        "reason": F.when(k % 8 == 0, "").when(k % 8 == 1, F.lit(None)).when(k % 8 == 2, F.repeat(F.lit("r"), C.REASON_MAX_CHARS))
        .when(k % 8 == 3, F.repeat(F.lit("r"), C.REASON_MAX_CHARS + 1)).otherwise("low score"),
        "mode": F.when(k % 5 == 0, "later").otherwise(F.col("mode"))})
    v = contracts.with_reasons(e, contracts.escalation_rules())
    return v.select("escalation_id", "valid", F.array_join("reasons", ",").alias("reasons"))


# --------------------------------------------------------------------------- GT19
@register("gt19_identity_normalize", with_views("identities", extra=(("n", f"""
SELECT decision_id, {strip_sql('tenant_id')} AS tenant_id, {strip_sql('agent_id')} AS agent_id FROM identities"""),)) + f"""
SELECT decision_id, tenant_id, agent_id, '{C.DEFAULT_PROFILE}' AS profile,
       coalesce(tenant_id, '') <> '' AND coalesce(agent_id, '') <> '' AS valid FROM n""")
def gt19_identity_normalize(spark, sf_dir):
    n = contracts.normalize_identity(T.identities(spark, sf_dir))
    return n.select("decision_id", "tenant_id", "agent_id", "profile", "valid")


# --------------------------------------------------------------------------- GT21
VIEW_FILTERS = {"event_class": "decision_summary", "model": "m-1", "tenant_id": "t-2"}


@register("gt21_saved_views", with_views("records") + """
SELECT decision_id, ts FROM records
WHERE event_class = 'decision_summary' AND model = 'm-1' AND tenant_id = 't-2'""")
def gt21_saved_views(spark, sf_dir):
    """A saved view over attribute maps: equality filters on text renderings, newest first."""
    rec = pack_attrs(T.records(spark, sf_dir), T.RECORD_ATTR_SPEC)
    return policy.saved_view_attrs(rec, VIEW_FILTERS).select("decision_id", "ts")


# --------------------------------------------------------------------------- GT22
def _conf_sql() -> str:
    parts = []
    for cfg in C.SCORE_CONFIGS:
        n = cfg["name"]
        if cfg["data_type"] == "NUMERIC":
            parts.append(f"WHEN rubric = '{n}' THEN s BETWEEN {cfg['min_value']} AND {cfg['max_value']}")
        else:
            vals = ", ".join(str(v) for _, v in cfg["categories"])
            parts.append(f"WHEN rubric = '{n}' THEN s IN ({vals})")
    return "CASE " + " ".join(parts) + " ELSE FALSE END"


@register("gt22_score_conformance", with_views("scores") + f"""
SELECT decision_id, rubric, s AS score, {_conf_sql()} AS conforms FROM (
  SELECT decision_id, rubric, CAST(score AS DOUBLE) AS s FROM scores
  UNION ALL
  SELECT decision_id, 'escalation_verdict', CAST(score AS DOUBLE) FROM scores WHERE tier = 'deep')""")
def gt22_score_conformance(spark, sf_dir):
    """Numeric rubric scores and (deep tier) verdict scores checked against their configs."""
    s = T.scores(spark, sf_dir).select("decision_id", "rubric", F.col("score").cast("double").alias("score"), "tier")
    verdicts = s.filter(F.col("tier") == "deep").withColumn("rubric", F.lit("escalation_verdict"))
    all_scores = s.unionByName(verdicts).drop("tier")
    return contracts.score_conformance(all_scores).select("decision_id", "rubric", "score", "conforms")


# --------------------------------------------------------------------------- GT25
AS_OF = "2024-01-31 00:00:00"
RETENTION_DAYS = 25


@register("gt25_retention_ttl", with_views("memories") + f"""
SELECT decision_id, event_id, kind FROM memories
WHERE (ttl_seconds IS NULL OR ts + to_seconds(CAST(ttl_seconds AS BIGINT)) > TIMESTAMP '{AS_OF}')
  AND ts > TIMESTAMP '{AS_OF}' - INTERVAL {RETENTION_DAYS} DAY""")
def gt25_retention_ttl(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return contracts.retention_filter(m, AS_OF, retention_days=RETENTION_DAYS).select("decision_id", "event_id", "kind")


# --------------------------------------------------------------------------- GT26
@register("gt26_tenant_scope", with_views("records") + "SELECT decision_id, ts, agent_id FROM records WHERE tenant_id = 't-2'")
def gt26_tenant_scope(spark, sf_dir):
    return policy.tenant_scope(T.records(spark, sf_dir), "t-2").select("decision_id", "ts", "agent_id")


# --------------------------------------------------------------------------- FN5 / FN6 / FN8
@register("fn5_decision_status", with_views("decision_flags") + f"""
SELECT decision_id, CASE WHEN blocked AND escalated THEN '{C.STATUS_BLOCKED_AND_ESCALATED}'
  WHEN blocked THEN '{C.STATUS_BLOCKED}' WHEN escalated THEN '{C.STATUS_ESCALATED}'
  WHEN exception IS NOT NULL THEN exception ELSE '{C.STATUS_OK}' END AS status FROM decision_flags""")
def fn5_decision_status(spark, sf_dir):
    d = T.decision_flags(spark, sf_dir)
    return d.select("decision_id", labels.decision_status(F.col("blocked"), F.col("escalated"),
                                                          F.col("exception")).alias("status"))


@register("fn6_severity_band", with_views("attempts") + """
SELECT attempt_id, CAST(score AS DOUBLE) AS score,
  CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium'
       WHEN score >= 0.25 THEN 'low' ELSE 'info' END AS severity,
  score >= 0.5 AS finding FROM attempts""")
def fn6_severity_band(spark, sf_dir):
    a = T.attempts(spark, sf_dir)
    s = F.col("score")
    return a.select("attempt_id", s.cast("double").alias("score"), labels.severity_band(s).alias("severity"),
                    labels.is_finding(s).alias("finding"))


@register("fn8_id_formats", with_views("records") + """
SELECT decision_id, lpad(lower(hex(decision_id)), 32, '0') AS trace_id,
       CASE WHEN event_class = '' THEN 'model' ELSE event_class || '.model' END AS redaction_path FROM records""")
def fn8_id_formats(spark, sf_dir):
    r = T.records(spark, sf_dir)
    return r.select("decision_id", labels.trace_id_hex(F.col("decision_id")).alias("trace_id"),
                    labels.redaction_path(F.col("event_class"), F.lit("model")).alias("redaction_path"))


# --------------------------------------------------------------------------- FN10 / FN11 (rows-only)
@register("fn10_attrs_json")
def fn10_attrs_json(spark, sf_dir):
    """Attribute maps rendered as plain JSON (sorted keys) for policy input."""
    rec = pack_attrs(T.records(spark, sf_dir), T.RECORD_ATTR_SPEC)
    return rec.select("decision_id", labels.attrs_to_json(F.col("attrs")).alias("attrs_json"))


@register("fn11_escalation_payload", with_views("escalations") + """
SELECT escalation_id, '{"kind":"decision.escalation","reason":"reason-' || CAST(required_rank AS VARCHAR) || '","mode":"' || mode || '"'
       || CASE WHEN decision_id % 2 = 0 THEN ',"rubric_id":"groundedness"' ELSE '' END
       || CASE WHEN decision_id % 4 = 0 THEN ',"triggering_score":' || CAST((decision_id % 100) / 100.0::DOUBLE AS VARCHAR) ELSE '' END || '}' AS payload
FROM escalations""")
def fn11_escalation_payload(spark, sf_dir):
    """Escalation payloads: rubric id and triggering score appear only when set."""
    e = T.escalations(spark, sf_dir)
    rubric = F.when(F.col("decision_id") % 2 == 0, F.lit("groundedness"))
    score = F.when(F.col("decision_id") % 4 == 0, (F.col("decision_id") % 100) / 100.0)
    return e.select("escalation_id", labels.escalation_payload(
        F.concat(F.lit("reason-"), F.col("required_rank").cast("string")), F.col("mode"), rubric, score).alias("payload"))
