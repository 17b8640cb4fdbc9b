"""Registered judging, escalation, accounting and streaming-twin jobs
(JN7-JN10, JN12, JN14, JN15, AG8-AG12, AG14, WN6, WN8, SM2-SM11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions.hashing import rate_threshold_hex
from tracefold.functions.pii import DEFAULT_ANALYZER, EMAIL_PATTERN, EMAIL_PATTERN_RE2
from tracefold.operators import accounting, decisions, escalation, gate_pipeline, graph, judging
from tracefold.operators.judging import Rubric
from tracefold.operators.ordering import dedupe_first
from tracefold.plans.oracle_views import with_views
from tracefold.plans.q_gates import STAGED_SQL, staged_records
from tracefold.plans.q_text import TENANT_KEY
from tracefold.plans.registry import register, sql_list
from tracefold.plans.sqlfrag import hmac_sql, placeholders_sql
from tracefold.sources import tables as T
from tracefold.streaming import twins

RUBRICS = (
    Rubric("factuality", has_retrievals=True, output_length_min=50, merge="min"),
    Rubric("harmlessness", always_escalate=False, merge="mean"),
    Rubric("instruction_following", output_length_min=200),
    Rubric("groundedness", merge="min"),
)


# --------------------------------------------------------------------------- JN7 / JN8
def _decision_rows(spark, sf_dir):
    d = T.records(spark, sf_dir).filter(F.col("event_class") == "decision_summary").select(
        "decision_id", F.col("output_tokens").alias("output_length"))
    r = decisions.retrieval_rollup(T.retrievals(spark, sf_dir)).select("decision_id", "retrieval_count")
    return d.join(r, "decision_id", "left")


@register("jn7_rubric_applicability", with_views("records", "retrievals") + """
SELECT d.decision_id, r.rubric_id FROM (
  SELECT d.decision_id, d.output_tokens AS ol, coalesce(x.n, 0) AS rc FROM records d
  LEFT JOIN (SELECT decision_id, count(*) AS n FROM retrievals GROUP BY decision_id) x ON d.decision_id = x.decision_id
  WHERE d.event_class = 'decision_summary') d,
  (VALUES ('factuality'), ('harmlessness'), ('instruction_following'), ('groundedness')) r(rubric_id)
WHERE (r.rubric_id = 'factuality' AND d.rc > 0 AND d.ol >= 50) OR r.rubric_id IN ('harmlessness', 'groundedness')
   OR (r.rubric_id = 'instruction_following' AND d.ol >= 200)""")
def jn7_rubric_applicability(spark, sf_dir):
    a = judging.applicable_rubrics(_decision_rows(spark, sf_dir), RUBRICS)
    return a.select("decision_id", "rubric_id")


@register("jn8_unscored_decisions", with_views("records", "scores") + """
SELECT decision_id FROM records d WHERE event_class = 'decision_summary'
  AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.decision_id = d.decision_id)""")
def jn8_unscored_decisions(spark, sf_dir):
    d = T.records(spark, sf_dir).filter(F.col("event_class") == "decision_summary").select("decision_id")
    return judging.unscored(d, T.scores(spark, sf_dir))


# --------------------------------------------------------------------------- JN9 / JN10
@register("jn9_escalation_review", with_views("qualified") + f"""
SELECT r.escalation_id, r.nonce, r.verdict,
  CASE WHEN e.escalation_id IS NULL THEN 'no_open_escalation' WHEN r.reviewer_rank < e.required_rank THEN 'role_too_low'
       WHEN r.received_at - r.reviewed_at > INTERVAL {C.STALE_VERDICT_DAYS} DAY THEN 'stale'
       WHEN e.fallback IN ('fail-closed', 'fail-open') AND r.reviewed_at > e.deadline THEN 'no_open_escalation'
       WHEN EXISTS (SELECT 1 FROM qualified q WHERE q.escalation_id = r.escalation_id
                    AND (q.reviewed_at < r.reviewed_at OR q.reviewed_at = r.reviewed_at AND q.nonce < r.nonce)) THEN 'no_open_escalation'
       ELSE 'accepted' END AS outcome
FROM reviews r LEFT JOIN escalations e ON r.escalation_id = e.escalation_id""")
def jn9_escalation_review(spark, sf_dir):
    m = escalation.match_reviews(T.reviews(spark, sf_dir), T.escalations(spark, sf_dir))
    return m.select("escalation_id", "nonce", "verdict", "outcome")


def _qualified(spark, sf_dir):
    return escalation.qualified_reviews(T.reviews(spark, sf_dir), T.escalations(spark, sf_dir))


@register("jn10_escalation_packet", with_views("escalations", "records", "scores") + f"""
SELECT e.escalation_id, e.decision_id, d.agent_id, d.model, CAST(d.cost_usd AS DOUBLE) AS cost_usd, d.latency_ms,
       coalesce(s.judge_scores, '') AS judge_scores, {placeholders_sql('d.internal_note')} AS review_note
FROM escalations e JOIN records d ON e.decision_id = d.decision_id
LEFT JOIN (SELECT decision_id, string_agg(rubric || '=' || CAST(s AS VARCHAR), ',' ORDER BY rubric || '=' || CAST(s AS VARCHAR)) AS judge_scores
           FROM (SELECT decision_id, rubric, min(score) AS s FROM scores GROUP BY ALL) GROUP BY decision_id) s
       ON e.decision_id = s.decision_id""")
def jn10_escalation_packet(spark, sf_dir):
    """Flattened, placeholder-redacted review row per escalation."""
    from tracefold.operators.redaction import placeholder_redact
    e = T.escalations(spark, sf_dir).select("escalation_id", "decision_id")
    d = T.records(spark, sf_dir).select("decision_id", "agent_id", "model", F.col("cost_usd").cast("double").alias("cost_usd"),
                                        "latency_ms", "internal_note")
    s = decisions.judge_score_labels(T.scores(spark, sf_dir))
    j = e.join(d, "decision_id").join(s, "decision_id", "left")
    return j.select("escalation_id", "decision_id", "agent_id", "model", "cost_usd", "latency_ms",
                    F.coalesce("judge_scores", F.lit("")).alias("judge_scores"),
                    placeholder_redact(F.col("internal_note")).alias("review_note"))


REVIEW_QUESTIONS = {"harmlessness": ("Is the answer harmful?", "Would you block it?"), "groundedness": ("Do the sources support the answer?",)}


def review_packets(spark, sf_dir):
    """Packets with the record's note as input, the document of the same number as output, and the user's decisions as session."""
    from tracefold.operators.ordering import sequence_within
    r = T.records(spark, sf_dir)
    seq = sequence_within(r.select("user_id", "decision_id"), ["user_id"], "decision_id").select(
        "decision_id", F.col("seq").alias("session_turn_number"))
    out = T.texts(spark, sf_dir).select(F.col("doc_id").alias("decision_id"), F.col("value").alias("output"))
    d = r.filter(F.col("event_class") == "escalation").select(
        "decision_id", "ts", F.col("internal_note").alias("input"), "user_id", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"))
    d = d.join(seq, "decision_id", "left").join(out, "decision_id", "left")
    parts = {"retrievals": graph.Part(T.retrievals(spark, sf_dir), ("source", "result_count"), ("ts", "event_id")),
             "guardrail_events": graph.Part(T.guard_events(spark, sf_dir), ("event_id", "policy", "blocked"), ("ts", "event_id"))}
    return escalation.review_packets(T.escalations(spark, sf_dir), d, T.scores(spark, sf_dir), parts, TENANT_KEY, REVIEW_QUESTIONS)


_ASKED_SQL = "CASE rubric " + " ".join(f"WHEN '{r}' THEN '{'|'.join(q)}'" for r, q in REVIEW_QUESTIONS.items()) + " ELSE '' END"


@register("jn10_review_packet", with_views("escalations", "records", "scores", "retrievals", "guard_events", "texts", extra=(("per", """
SELECT decision_id, rubric, min(score) AS s FROM scores GROUP BY ALL"""), ("judged", """
SELECT decision_id, arg_min(rubric, (s, rubric)) AS rubric, min(s) AS low,
       string_agg(rubric || '=' || CAST(s AS VARCHAR), ',' ORDER BY rubric) AS all_scores FROM per GROUP BY decision_id"""), ("seq", """
SELECT decision_id, row_number() OVER (PARTITION BY user_id ORDER BY decision_id) AS n FROM records"""))) + f"""
SELECT e.escalation_id, e.decision_id, e.tenant_id, d.ts AS decision_timestamp, {placeholders_sql('d.internal_note')} AS input_redacted,
       {placeholders_sql('t.value')} AS output_redacted, coalesce(rt.l, '') AS retrievals, coalesce(g.l, '') AS guardrail_events,
       j.rubric AS triggering_rubric_id, CAST(j.low AS DOUBLE) AS triggering_score, coalesce(j.all_scores, '') AS all_judge_scores,
       {hmac_sql('CAST(d.user_id AS VARCHAR)', TENANT_KEY)} AS user_id_hash, {hmac_sql("('s' || CAST(d.user_id AS VARCHAR))", TENANT_KEY)} AS session_id_hash,
       seq.n AS session_turn_number, {_ASKED_SQL} AS review_questions, '4h' AS expected_response_time
FROM escalations e JOIN records d ON e.decision_id = d.decision_id JOIN seq ON seq.decision_id = d.decision_id
LEFT JOIN texts t ON t.doc_id = e.decision_id LEFT JOIN judged j ON j.decision_id = e.decision_id
LEFT JOIN (SELECT decision_id, string_agg(source || ':' || CAST(result_count AS VARCHAR), ',' ORDER BY ts, event_id) AS l FROM retrievals GROUP BY 1) rt
       ON rt.decision_id = e.decision_id
LEFT JOIN (SELECT decision_id, string_agg(CAST(event_id AS VARCHAR) || ':' || policy || ':' || CAST(blocked AS VARCHAR), ',' ORDER BY ts, event_id) AS l
           FROM guard_events GROUP BY 1) g ON g.decision_id = e.decision_id""")
def jn10_review_packet(spark, sf_dir):
    """The whole packet of each escalation; arrays rendered as text."""
    def text(name, *fields, sep=":"):
        return F.coalesce(F.array_join(F.transform(name, lambda x: F.concat_ws(sep, *[x[f].cast("string") for f in fields])), ","), F.lit("")).alias(name)

    return review_packets(spark, sf_dir).select(
        "escalation_id", "decision_id", "tenant_id", "decision_timestamp", "input_redacted", "output_redacted", text("retrievals", "source", "result_count"),
        text("guardrail_events", "event_id", "policy", "blocked"), "triggering_rubric_id", F.col("triggering_score").cast("double").alias("triggering_score"),
        text("all_judge_scores", "rubric", "score", sep="="), "user_id_hash", "session_id_hash", "session_turn_number",
        F.array_join("review_questions", "|").alias("review_questions"), "expected_response_time")


# --------------------------------------------------------------------------- JN12
@register("jn12_output_only_pii", with_views("turns", extra=(("io", """
SELECT session_id, turn, role, text, lag(text) OVER (PARTITION BY session_id ORDER BY turn) AS prev_text,
       lag(role) OVER (PARTITION BY session_id ORDER BY turn) AS prev_role FROM turns"""), ("o", f"""
SELECT DISTINCT session_id, turn, sha256(unnest(regexp_extract_all(text, '{EMAIL_PATTERN_RE2}'))) AS entity_hash
FROM io WHERE role = 'assistant'"""), ("i", f"""
SELECT DISTINCT session_id, turn, sha256(unnest(regexp_extract_all(prev_text, '{EMAIL_PATTERN_RE2}'))) AS entity_hash
FROM io WHERE role = 'assistant' AND prev_role = 'user'"""))) + """
SELECT session_id, turn, entity_hash FROM o
WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.session_id = o.session_id AND i.turn = o.turn AND i.entity_hash = o.entity_hash)""")
def jn12_output_only_pii(spark, sf_dir):
    """E-mail entities in an assistant turn that the preceding user turn did not contain."""
    from tracefold.operators.ordering import sequence_within
    t = T.turns(spark, sf_dir)
    seq = sequence_within(t.select("session_id", "turn"), ["session_id"], "turn", prev_col="prev_turn")
    out = t.filter(F.col("role") == "assistant").join(seq.select("session_id", "turn", "prev_turn"),
                                                      ["session_id", "turn"])
    prev = t.filter(F.col("role") == "user").select("session_id", F.col("turn").alias("prev_turn"),
                                                    F.col("text").alias("in_text"))
    inp = out.join(prev, ["session_id", "prev_turn"]).select("session_id", "turn", F.col("in_text").alias("text"))
    return judging.output_only_entities(inp, out.select("session_id", "turn", "text"), ["session_id", "turn"], "text",
                                        EMAIL_PATTERN)


# --------------------------------------------------------------------------- JN14
CONTROLS = {
    "eu_ai_act.article_12": ("decisions", "escalation-log", "deletions-log"),
    "eu_ai_act.article_13": ("decisions", "model-changes", "transparency-notices"),     # no rows; no dataset
    "eu_ai_act.article_14": ("escalation-log", "human-attestations"),
    "eu_ai_act.article_15": ("redteam-reports", "decisions"),
}


@register("jn14_control_coverage", with_views("records", "escalations", "reviews", "attempts", extra=(("ev", """
SELECT 'decisions' AS kind, count(*) AS n FROM records WHERE event_class = 'decision_summary'
UNION ALL SELECT 'model-changes', count(*) FROM records WHERE event_class = 'model_change'
UNION ALL SELECT 'escalation-log', count(*) FROM escalations
UNION ALL SELECT 'human-attestations', count(*) FROM reviews
UNION ALL SELECT 'redteam-reports', count(DISTINCT run_id) FROM attempts
UNION ALL SELECT 'deletions-log', count(*) FROM records
  WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 300)"""), ("cfg", """
SELECT * FROM (VALUES ('eu_ai_act.article_12', 'decisions'), ('eu_ai_act.article_12', 'escalation-log'),
  ('eu_ai_act.article_12', 'deletions-log'), ('eu_ai_act.article_13', 'decisions'), ('eu_ai_act.article_13', 'model-changes'),
  ('eu_ai_act.article_13', 'transparency-notices'), ('eu_ai_act.article_14', 'escalation-log'),
  ('eu_ai_act.article_14', 'human-attestations'), ('eu_ai_act.article_15', 'redteam-reports'),
  ('eu_ai_act.article_15', 'decisions')) t(control, kind)"""))) + """
SELECT control, count(*) AS n_kinds, CAST(sum(coalesce(n, 0)) AS BIGINT) AS evidence_rows,
       coalesce(string_agg(CASE WHEN coalesce(n, 0) = 0 THEN kind END, ',' ORDER BY kind), '') AS gaps,
       coalesce(string_agg(CASE WHEN coalesce(n, 0) = 0 THEN kind END, ','), '') = '' AS covered
FROM cfg LEFT JOIN ev USING (kind) GROUP BY control""")
def jn14_control_coverage(spark, sf_dir):
    """Evidence rows per control from the datasets; deletions come from the erasure cascade."""
    rec = T.records(spark, sf_dir)
    ev = T.read_table(spark, sf_dir, "events")
    req = ev.filter((F.col("event_type") == "signup") & (F.col("value") > 300)).select("user_id")
    erased = graph.erase_user(rec.select("decision_id", "user_id", "internal_note"), req)
    deletions = graph.deletion_events(erased, "decision_id", "2024-02-01 00:00:00")
    counts = (rec.filter(F.col("event_class") == "decision_summary").agg(F.count(F.lit(1)).alias("n_rows"))
                 .select(F.lit("decisions").alias("kind"), "n_rows")
              .unionByName(rec.filter(F.col("event_class") == "model_change").agg(F.count(F.lit(1)).alias("n_rows"))
                           .select(F.lit("model-changes").alias("kind"), "n_rows"))
              .unionByName(T.escalations(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))
                           .select(F.lit("escalation-log").alias("kind"), "n_rows"))
              .unionByName(T.reviews(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))
                           .select(F.lit("human-attestations").alias("kind"), "n_rows"))
              .unionByName(T.attempts(spark, sf_dir).agg(F.count_distinct("run_id").alias("n_rows"))
                           .select(F.lit("redteam-reports").alias("kind"), "n_rows"))
              .unionByName(deletions.agg(F.count(F.lit(1)).alias("n_rows"))
                           .select(F.lit("deletions-log").alias("kind"), "n_rows")))
    return judging.control_coverage(spark, CONTROLS, counts)


# --------------------------------------------------------------------------- JN15
@register("jn15_judge_inline_disagreement", with_views("guard_events", "scores") + f"""
SELECT g.decision_id, g.blocked, CAST(s.score AS DOUBLE) < {C.ESCALATION_SCORE_THRESHOLD} AS judged_unsafe, s.rubric
FROM (SELECT decision_id, bool_or(blocked) AS blocked FROM guard_events GROUP BY decision_id) g
JOIN scores s ON g.decision_id = s.decision_id
WHERE g.blocked <> (CAST(s.score AS DOUBLE) < {C.ESCALATION_SCORE_THRESHOLD})""")
def jn15_judge_inline_disagreement(spark, sf_dir):
    inline = T.guard_events(spark, sf_dir).groupBy("decision_id").agg(F.bool_or("blocked").alias("blocked"))
    j = judging.disagreements(inline, T.scores(spark, sf_dir).select("decision_id", "rubric", "score"))
    return j.select("decision_id", "blocked", "judged_unsafe", "rubric")


# --------------------------------------------------------------------------- AG8 / AG9
@register("ag8_batch_manifest", with_views("records", extra=(("st", STAGED_SQL),)) + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS batch, count(*) AS input_count, count(*) FILTER (WHERE drop_reason IS NULL) AS output_count,
       count(*) FILTER (WHERE drop_reason = 'schema') AS dropped_schema, count(*) FILTER (WHERE drop_reason = 'redaction') AS dropped_redaction,
       count(*) FILTER (WHERE drop_reason = 'policy') AS dropped_policy, count(*) FILTER (WHERE drop_reason = 'sampler') AS dropped_sampler,
       count(*) FILTER (WHERE drop_reason IS NULL AND hashed) AS hashed_internal_note,
       count(*) FILTER (WHERE drop_reason IS NULL AND category = 'EMAIL_ADDRESS') AS "hashed_internal_note_EMAIL_ADDRESS",
       count(*) FILTER (WHERE drop_reason IS NULL AND category = 'PHONE_NUMBER') AS "hashed_internal_note_PHONE_NUMBER", count(*) FILTER (WHERE oversized) AS oversized_internal_note
FROM st GROUP BY 1""")
def ag8_batch_manifest(spark, sf_dir):
    """Per daily batch: input/output counts, drops by the stage that dropped them, hashed notes by category, oversized notes."""
    s = staged_records(spark, sf_dir).withColumn("batch", F.window("ts", "1 day")["start"])
    return accounting.manifest_rows(s, "batch", "drop_reason", gate_pipeline.STAGES, ["internal_note"], [c for c, _ in DEFAULT_ANALYZER.rules])


@register("ag9_stage_metrics", with_views("records", extra=(("st", STAGED_SQL),)) + """
SELECT event_class, CASE WHEN drop_reason IS NULL THEN 'sent' ELSE 'dropped_' || drop_reason END AS outcome,
       CASE WHEN latency_ms <= 10 THEN 'le_10' WHEN latency_ms <= 50 THEN 'le_50' WHEN latency_ms <= 100 THEN 'le_100'
            WHEN latency_ms <= 250 THEN 'le_250' ELSE 'inf' END AS latency_bucket,
       count(*) AS n_events, min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms
FROM st GROUP BY ALL""")
def ag9_stage_metrics(spark, sf_dir):
    s = staged_records(spark, sf_dir).withColumn(
        "outcome", F.when(F.col("drop_reason").isNull(), F.lit("sent")).otherwise(F.concat(F.lit("dropped_"), "drop_reason")))
    return accounting.stage_metrics(s, "event_class", "outcome", "observed_ms").withColumnsRenamed(
        {"min_observed_ms": "min_latency_ms", "max_observed_ms": "max_latency_ms"})


@register("ag9_latency_percentiles")
def ag9_latency_percentiles(spark, sf_dir):
    """Latency percentiles per class, merged from the sketches of its days and stages."""
    s = staged_records(spark, sf_dir).select("event_class", F.to_date("ts").alias("day"), F.coalesce("drop_reason", F.lit("sent")).alias("outcome"), "observed_ms")
    return accounting.merged_percentiles(accounting.latency_sketches(s, ["event_class", "day", "outcome"], "observed_ms"), ["event_class"])


# --------------------------------------------------------------------------- AG10
@register("ag10_chunk_score_merge", with_views("texts", extra=(("ch", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'groundedness' ELSE 'harmlessness' END AS rubric,
       CAST(CAST((doc_id * 37 + (i - 1) * 11) % 100 AS DECIMAL(9,0)) / 100 AS DECIMAL(9,2)) AS score
FROM (SELECT doc_id, generate_subscripts(string_split(value, chr(10)), 1) AS i FROM texts)"""),)) + """
SELECT doc_id, rubric, count(*) AS n_chunks,
       CASE WHEN rubric = 'groundedness' THEN CAST(min(score) AS DOUBLE)
            ELSE CAST(sum(CAST(score AS DECIMAL(18,6))) AS DOUBLE) / count(*) END AS merged_score
FROM ch GROUP BY doc_id, rubric""")
def ag10_chunk_score_merge(spark, sf_dir):
    """Line chunks scored per rubric, merged per document: min for groundedness, mean otherwise."""
    t = T.texts(spark, sf_dir)
    ch = judging.split_chunks(t, ["doc_id"], "value")
    ch = ch.select("doc_id",
                   F.when(F.col("doc_id") % 2 == 0, "groundedness").otherwise("harmlessness").alias("rubric"),
                   (((F.col("doc_id") * 37 + F.col("chunk_idx") * 11) % 100).cast("decimal(9,0)") / 100)
                   .cast("decimal(9,2)").alias("score"))
    return judging.chunk_merge(ch, ["doc_id"], "rubric", "score", {r.rubric_id: r for r in RUBRICS})


# --------------------------------------------------------------------------- AG11 / AG12 / AG14
@register("ag11_escalation_rate_alert", with_views("records", extra=(("r", """
SELECT agent_id, event_class = 'escalation' AND (user_id % 4 <> 0 OR decision_id % 8 = 0) AS escalated FROM records"""),)) + f"""
SELECT agent_id, count(*) AS n_decisions, count(*) FILTER (WHERE escalated) AS n_escalated,
       count(*) FILTER (WHERE escalated) / count(*) AS share, count(*) FILTER (WHERE escalated) / count(*) > {C.ESCALATION_ALERT_SHARE} AS alert
FROM r GROUP BY agent_id""")
def ag11_escalation_rate_alert(spark, sf_dir):
    """Agents above the alert share; every fourth agent escalates only an eighth of its errors and stays below."""
    careful = (F.col("user_id") % 4 != 0) | (F.col("decision_id") % 8 == 0)
    r = T.records(spark, sf_dir).withColumn("escalated", (F.col("event_class") == "escalation") & careful)
    return escalation.escalation_rate(r)


FETCH_THRESHOLD = 12


@register("ag12_reviewer_fetch_abuse", with_views("fetches") + f"""
SELECT reviewer_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n_fetches
FROM fetches GROUP BY ALL HAVING count(*) > {FETCH_THRESHOLD}""")
def ag12_reviewer_fetch_abuse(spark, sf_dir):
    return escalation.fetch_abuse(T.fetches(spark, sf_dir), "1 day", FETCH_THRESHOLD)


PENDING_AS_OF = "2024-01-15 00:00:00"


@register("ag14_pending_gauge", with_views("qualified") + f"""
SELECT tenant_id, count(*) AS open_escalations FROM escalations e
WHERE requested_at <= TIMESTAMP '{PENDING_AS_OF}'
  AND NOT EXISTS (SELECT 1 FROM qualified r WHERE r.escalation_id = e.escalation_id AND r.reviewed_at <= TIMESTAMP '{PENDING_AS_OF}')
GROUP BY tenant_id""")
def ag14_pending_gauge(spark, sf_dir):
    return escalation.pending_gauge(T.escalations(spark, sf_dir), _qualified(spark, sf_dir), PENDING_AS_OF)


# --------------------------------------------------------------------------- WN6 / WN8
@register("wn6_conflicting_verdicts", with_views("qualified") + """
SELECT escalation_id, first_verdict, count(*) FILTER (WHERE verdict <> first_verdict) AS n_conflicting,
       count(*) FILTER (WHERE verdict <> first_verdict) > 0 AS alert FROM (
  SELECT r.*, first_value(verdict) OVER (PARTITION BY escalation_id ORDER BY reviewed_at, nonce) AS first_verdict FROM qualified r)
GROUP BY escalation_id, first_verdict""")
def wn6_conflicting_verdicts(spark, sf_dir):
    return escalation.conflicting_verdicts(_qualified(spark, sf_dir))


@register("wn8_score_trend", with_views("scores") + """
SELECT agent_id, rubric, day, n, CAST(s AS DOUBLE) / n AS day_avg,
       CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w AS trailing_avg FROM (
  SELECT agent_id, rubric, CAST(ts AS DATE) AS day, CAST(sum(CAST(score AS DECIMAL(18,6))) AS DECIMAL(38,6)) AS s, count(*) AS n
  FROM scores GROUP BY ALL)
WINDOW w AS (PARTITION BY agent_id, rubric ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def wn8_score_trend(spark, sf_dir):
    return judging.daily_trend(T.scores(spark, sf_dir), ["agent_id", "rubric"], "ts", "score")


# --------------------------------------------------------------------------- SM2-SM11 batch twins
@register("sm2_late_data", with_views("arrivals", extra=(("b", """
SELECT *, CAST(floor(epoch_us(arrived_at) / 300000000) AS BIGINT) AS batch FROM arrivals"""), ("wm", """
SELECT batch, max(mx) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 60 SECOND AS watermark
FROM (SELECT batch, max(ts) AS mx FROM b GROUP BY batch)"""))) + """
SELECT b.event_id, b.batch, coalesce(b.ts < wm.watermark, FALSE) AS late FROM b JOIN wm USING (batch)""")
def sm2_late_data(spark, sf_dir):
    """Rows a 60-second watermark drops when events arrive up to 10 minutes late (5-minute micro-batches)."""
    l = twins.late_events(T.arrivals(spark, sf_dir), "ts", "arrived_at", 60, 300)
    return l.select("event_id", "batch", "late")


@register("sm3_streaming_dedupe", with_views("deliveries") + """
SELECT decision_id, event_id, min(arrived_at) AS arrived_at, bool_or(blocked) AS blocked FROM deliveries GROUP BY decision_id, event_id""")
def sm3_streaming_dedupe(spark, sf_dir):
    return dedupe_first(T.deliveries(spark, sf_dir), ["decision_id", "event_id"], ["arrived_at"])


@register("sm4_nonce_replay", with_views("reviews") + """
SELECT nonce, count(*) AS deliveries, count(*) FILTER (WHERE prev IS NOT NULL AND reviewed_at <= prev + INTERVAL 24 HOUR) AS rejected
FROM (SELECT nonce, reviewed_at, lag(reviewed_at) OVER (PARTITION BY nonce ORDER BY reviewed_at) AS prev FROM reviews)
GROUP BY nonce""")
def sm4_nonce_replay(spark, sf_dir):
    return escalation.nonce_replays(T.reviews(spark, sf_dir))


@register("sm5_tumbling_usage", with_views("records") + """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
       tenant_id, count(*) AS request_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd
FROM records GROUP BY ALL""")
def sm5_tumbling_usage(spark, sf_dir):
    return accounting.usage_by_window(T.records(spark, sf_dir), "5 minutes", keys=("tenant_id",))


RATE_LIMIT = 3


@register("sm6_rate_limit", with_views("records") + f"""
SELECT agent_id, decision_id, bucket_start, seq_in_bucket FROM (
  SELECT agent_id, decision_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start,
         row_number() OVER (PARTITION BY agent_id, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, decision_id) AS seq_in_bucket
  FROM records) WHERE seq_in_bucket <= {RATE_LIMIT}""")
def sm6_rate_limit(spark, sf_dir):
    """At most 3 records per agent and hour pass (the same rule at 100 per second in production)."""
    r = T.records(spark, sf_dir).select("agent_id", "decision_id", "ts")
    return twins.rate_limited(r, ["agent_id"], "ts", "decision_id", RATE_LIMIT, "1 hour").select(
        "agent_id", "decision_id", "bucket_start", "seq_in_bucket")


FALLBACK_AS_OF = "2024-02-01 00:00:00"


@register("sm7_deadline_fallback", with_views("qualified") + f"""
SELECT escalation_id, fallback, CASE fallback WHEN 'fail-closed' THEN 'reject' WHEN 'fail-open' THEN 'approve' END AS verdict,
       '{C.TIMEOUT_REVIEWER}' AS reviewer_id, CASE WHEN fallback = 'defer' THEN 'open' ELSE 'closed' END AS status
FROM escalations e WHERE deadline < TIMESTAMP '{FALLBACK_AS_OF}'
  AND NOT EXISTS (SELECT 1 FROM qualified r WHERE r.escalation_id = e.escalation_id AND r.reviewed_at <= e.deadline)""")
def sm7_deadline_fallback(spark, sf_dir):
    return escalation.deadline_fallback(T.escalations(spark, sf_dir), _qualified(spark, sf_dir), FALLBACK_AS_OF)


@register("sm8_verdict_idempotency", with_views("qualified", extra=(("n", """
SELECT escalation_id, nonce, verdict, min(reviewed_at) AS reviewed_at, count(*) AS deliveries FROM qualified GROUP BY ALL"""),
    ("f", """
SELECT escalation_id, nonce AS first_nonce, verdict AS first_verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY escalation_id ORDER BY reviewed_at, nonce) AS rn FROM n) WHERE rn = 1"""))) + """
SELECT n.escalation_id, n.nonce, n.verdict, n.deliveries,
       CASE WHEN n.nonce = f.first_nonce THEN 'accepted' WHEN n.verdict = f.first_verdict THEN 'duplicate' ELSE 'conflict' END AS outcome
FROM n JOIN f USING (escalation_id)""")
def sm8_verdict_idempotency(spark, sf_dir):
    return escalation.verdict_idempotency(_qualified(spark, sf_dir))


JUDGE_KEY = b"tracefold-judge-sample-key"


@register("sm9_judge_funnel", with_views("scores") + f"""
SELECT decision_id, rubric, deep_sampled,
       CASE WHEN tier = 'fast' AND (s < {C.JUDGE_FAST_FLAG} OR deep_sampled OR warned) THEN 'deep'
            WHEN tier = 'deep' AND s < {C.JUDGE_DEEP_FLAG} THEN 'human' ELSE 'done' END AS route
FROM (SELECT decision_id, rubric, CAST(score AS DOUBLE) AS s, tier, output_length > 5000 AS warned,
             substr({hmac_sql('CAST(decision_id AS VARCHAR)', JUDGE_KEY)}, 1, 16) < '{rate_threshold_hex(C.JUDGE_DEEP_SAMPLE_RATE)}' AS deep_sampled
      FROM scores)""")
def sm9_judge_funnel(spark, sf_dir):
    s = T.scores(spark, sf_dir).withColumn("warned", F.col("output_length") > 5000)
    f = judging.judge_funnel(s, JUDGE_KEY, policy_col="warned")
    return f.select("decision_id", "rubric", "deep_sampled", "route")


FLAG_RUBRICS = (Rubric("groundedness", deep_flag=0.5), Rubric("harmlessness", always_escalate=True, deep_flag=0.3))


@register("sm10_flag_escalation", with_views("scores") + """
SELECT decision_id, rubric,
  CASE WHEN rubric = 'harmlessness' THEN 'always_escalate'
       WHEN tier = 'deep' AND CAST(score AS DOUBLE) < 0.5 THEN 'below_deep_flag'
       WHEN tier = 'deep' AND output_length > 5000 THEN 'reviewed_category_warn' END AS escalation_reason
FROM scores""")
def sm10_flag_escalation(spark, sf_dir):
    """Scores that open an escalation: always-escalate rubric, below the deep flag, or a warned category."""
    s = T.scores(spark, sf_dir).withColumn("warned", (F.col("tier") == "deep") & (F.col("output_length") > 5000))
    f = judging.flag_escalations(s, FLAG_RUBRICS, warn_col="warned")
    return f.select("decision_id", "rubric", "escalation_reason")


@register("sm11_ordered_fold", with_views("guard_events") + """
SELECT decision_id, count(*) AS n_events, max(CASE WHEN rf = 1 THEN event_id END) AS first_event,
       max(CASE WHEN rl = 1 THEN event_id END) AS last_event, bool_or(CASE WHEN rl = 1 THEN blocked END) AS last_blocked,
       max(CASE WHEN rl = 1 THEN policy END) AS last_policy
FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY ts, event_id) AS rf,
             row_number() OVER (PARTITION BY decision_id ORDER BY ts DESC, event_id DESC) AS rl FROM guard_events)
GROUP BY decision_id""")
def sm11_ordered_fold(spark, sf_dir):
    """Per decision, the state after applying its events in (ts, event_id) order."""
    g = T.guard_events(spark, sf_dir)
    return twins.ordered_fold(g, ["decision_id"], ["ts", "event_id"], ["blocked", "policy"])

