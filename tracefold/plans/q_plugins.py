"""Registered plug-in, dry-run and rolling-window jobs (UD1-UD3, SC5, WN7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions import plugins
from tracefold.operators import gate_pipeline, gates, judging
from tracefold.operators.ordering import sequence_within
from tracefold.plans.oracle_views import with_views
from tracefold.plans.q_gates import SAMPLER_KEY, STAGED_SQL, gate_args
from tracefold.plans.q_text import TENANT_KEY
from tracefold.plans.registry import register
from tracefold.plans.sqlfrag import hmac_sql, pii_cat_sql, rails_sql, strip_sql
from tracefold.sources import sinks
from tracefold.sources import tables as T


@register("ud1_pii_analyzer_plugin", with_views("texts") + f"""
SELECT doc_id, {pii_cat_sql('value')} IS NOT NULL AS has_pii, {pii_cat_sql('value')} AS category FROM texts""")
def ud1_pii_analyzer_plugin(spark, sf_dir):
    """A user Python analyzer (Arrow batches) deciding PII per text."""
    udf = plugins.analyzer_udf(plugins.regex_analyzer)
    t = T.texts(spark, sf_dir)
    return t.select("doc_id", udf(F.col("value")).alias("a")).select("doc_id", "a.has_pii", "a.category")


@register("ud2_rails_plugin", with_views("turns") + f"""
SELECT session_id, turn, NOT ({rails_sql('text')}) AS allowed, CASE WHEN {rails_sql('text')} THEN 'block' ELSE 'allow' END AS action,
       CASE WHEN {rails_sql('text')} THEN '{C.JAILBREAK_RAIL}' ELSE 'on_topic' END AS rail
FROM turns WHERE role IN ('user', 'assistant')""")
def ud2_rails_plugin(spark, sf_dir):
    """A user Python rail engine over every user and assistant turn."""
    udf = plugins.rails_udf(plugins.keyword_rails)
    t = T.turns(spark, sf_dir).filter(F.col("role").isin("user", "assistant"))
    phase = F.when(F.col("role") == "user", "input").otherwise("output_final")
    return t.select("session_id", "turn", udf(phase, F.lit("turn.text"), F.col("text")).alias("r")).select(
        "session_id", "turn", "r.allowed", "r.action", "r.rail")


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[{C.PY_WHITESPACE_CLASS}]+'), lambda w: w <> '')"


@register("ud3_judge_plugin", with_views("turns", extra=(("p", f"""
SELECT session_id, turn, role, {_words_sql('text')} AS w, lag(role) OVER s AS prev_role, lag({_words_sql('text')}) OVER s AS pw
FROM turns WINDOW s AS (PARTITION BY session_id ORDER BY turn)"""), ("s", """
SELECT session_id, turn, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: list_contains(pw, x)))::DOUBLE / len(w) END AS score
FROM p WHERE role = 'assistant' AND prev_role = 'user'"""))) + f"""
SELECT session_id, turn, score, score < {C.ESCALATION_SCORE_THRESHOLD} AS escalate FROM s""")
def ud3_judge_plugin(spark, sf_dir):
    """A user Python judge scoring each (user turn, next assistant turn) pair; low scores escalate."""
    t = T.turns(spark, sf_dir)
    seq = sequence_within(t.select("session_id", "turn"), ["session_id"], "turn", prev_col="prev_turn")
    out = t.filter(F.col("role") == "assistant").join(seq.select("session_id", "turn", "prev_turn"),
                                                      ["session_id", "turn"])
    inp = t.filter(F.col("role") == "user").select("session_id", F.col("turn").alias("prev_turn"),
                                                   F.col("text").alias("prompt"))
    pairs = out.join(inp, ["session_id", "prev_turn"])
    score = plugins.judge_udf(plugins.overlap_judge)(F.col("prompt"), F.col("text"))
    return pairs.select("session_id", "turn", score.alias("score")).withColumn(
        "escalate", plugins.escalate_on(F.col("score")))


@register("sc5_dry_run_summary", with_views("records", extra=(("st", STAGED_SQL),)) + """
SELECT CAST(ts AS DATE) AS day, event_class, count(*) AS would_send FROM st WHERE drop_reason IS NULL GROUP BY ALL""")
def sc5_dry_run_summary(spark, sf_dir):
    """Daily "would have been sent" counts by class after all stages."""
    return sinks.would_send_summary(gate_pipeline.gated(T.records(spark, sf_dir), sampler_key=SAMPLER_KEY, **gate_args()))


_TOK = judging.TOKEN_SEP


def _wn7_sql() -> str:
    occ = []
    for p in C.JAILBREAK_PHRASES:
        pt = p.lower().split()
        lit = "[" + ", ".join(f"'{x}'" for x in pt) + "]"
        n = len(pt)
        occ.append(f"list_transform(list_filter(range(1, greatest(len(tok) - {n} + 1, 0) + 1), "
                   f"lambda s: tok[s:s + {n - 1}] = {lit}), lambda s: {{'s': s, 'e': s + {n - 1}}})")
    occ_sql = "flatten([" + ", ".join(occ) + "])"
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return with_views("turns", extra=(("b", f"""
SELECT session_id, turn, text,
       CASE WHEN trim(lower(text), {ws}) = '' THEN []::VARCHAR[]
            ELSE regexp_split_to_array(trim(lower(text), {ws}), '{_TOK}') END AS tok
FROM turns WHERE role = 'assistant'"""), ("o", f"""
SELECT session_id, turn, {occ_sql} AS occ FROM b"""), ("c", f"""
SELECT session_id, turn, i - 1 AS chunk_idx, CASE WHEN trim(chunk, {ws}) = '' THEN 0
       ELSE len(regexp_split_to_array(trim(chunk, {ws}), '{_TOK}')) END AS n
FROM (SELECT session_id, turn, unnest(string_split(text, chr(10))) AS chunk,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b)"""))) + """
SELECT c.session_id, c.turn, CAST(c.chunk_idx AS INTEGER) AS chunk_idx, CAST(c.chunk_end AS BIGINT) AS chunk_end,
       len(list_filter(o.occ, lambda x: x.s > c.chunk_end - 256 AND x.e <= c.chunk_end)) > 0 AS flagged
FROM (SELECT *, sum(n) OVER (PARTITION BY session_id, turn ORDER BY chunk_idx) AS chunk_end FROM c) c
JOIN o ON c.session_id = o.session_id AND c.turn = o.turn"""


@register("wn7_rolling_content_window", _wn7_sql())
def wn7_rolling_content_window(spark, sf_dir):
    """Assistant outputs streamed line by line: a jailbreak phrase within the last 256 tokens flags the chunk."""
    t = T.turns(spark, sf_dir).filter(F.col("role") == "assistant")
    return judging.rolling_window_flags(t, ["session_id", "turn"], "text", C.JAILBREAK_PHRASES)


# --------------------------------------------------------------------------- SM1 / JN2
@register("sm1_streaming_gate", with_views("records", extra=(("st", STAGED_SQL),)) + f"""
SELECT decision_id, event_class, tenant_id, agent_id, input_tokens,
       CASE WHEN hashed THEN {hmac_sql(strip_sql('note'), TENANT_KEY)} ELSE note END AS internal_note
FROM st WHERE drop_reason IS NULL""")
def sm1_streaming_gate(spark, sf_dir):
    """The stateless stream gate (allowlist -> redaction -> policy -> sampler) applied to the bounded table.

    The policy runs on the gated record, so an attribute the allowlist removed
    is absent (null) to the policy, which then fails closed."""
    from tracefold.streaming import live
    g = live.gate_stream(T.records(spark, sf_dir), key=SAMPLER_KEY, **gate_args())
    return g.select("decision_id", "event_class", "tenant_id", "agent_id", "input_tokens", "internal_note")


@register("jn2_decision_summary_fold", with_views("records", "retrievals", "memories", "guard_events", "scores") + """
SELECT d.decision_id, d.agent_id, d.model,
       coalesce(r.n, 0) AS retrieval_count, coalesce(r.src, '') AS retrieval_sources,
       coalesce(m.n, 0) AS memory_write_count, coalesce(m.kinds, '') AS memory_kinds,
       coalesce(g.n, 0) AS guardrail_events, coalesce(g.blocked, FALSE) AS blocked,
       coalesce(g.escalated, FALSE) AS escalated, coalesce(s.js, '') AS judge_scores
FROM (SELECT decision_id, agent_id, model FROM records WHERE event_class = 'decision_summary') d
LEFT JOIN (SELECT decision_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS src
           FROM retrievals GROUP BY 1) r ON d.decision_id = r.decision_id
LEFT JOIN (SELECT decision_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds
           FROM memories GROUP BY 1) m ON d.decision_id = m.decision_id
LEFT JOIN (SELECT decision_id, count(*) AS n, bool_or(blocked) AS blocked, bool_or(escalated) AS escalated
           FROM guard_events GROUP BY 1) g ON d.decision_id = g.decision_id
LEFT JOIN (SELECT decision_id, string_agg(rubric || '=' || CAST(s AS VARCHAR), ',' ORDER BY rubric || '=' || CAST(s AS VARCHAR)) AS js
           FROM (SELECT decision_id, rubric, min(score) AS s FROM scores GROUP BY ALL) GROUP BY 1) s
       ON d.decision_id = s.decision_id""")
def jn2_decision_summary_fold(spark, sf_dir):
    """Decision summary folded from flat child tables (retrievals, memory writes, guardrail events, scores)."""
    from tracefold.operators import decisions
    d = T.records(spark, sf_dir).filter(F.col("event_class") == "decision_summary").select(
        "decision_id", "agent_id", "model")
    return decisions.decision_summary_flat(d, T.retrievals(spark, sf_dir), T.memories(spark, sf_dir),
                                           T.guard_events(spark, sf_dir), T.scores(spark, sf_dir))


# --------------------------------------------------------------------------- GT6 / GT7
def _prefix_sql(col: str) -> str:
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in C.default_span_prefixes()) + ")"


@register("gt6_span_prefix_allowlist", with_views("turn_span_attrs", extra=(("k", f"""
SELECT * FROM turn_span_attrs WHERE {_prefix_sql('key')} AND NOT (vtype = 'str' AND strlen(vstr) > {C.DEFAULT_MAX_FIELD_BYTES})"""),
    ("live", """
SELECT DISTINCT trace_id, span_id FROM k WHERE scope IN ('span', 'event')"""))) + """
SELECT k.trace_id, k.span_id, scope, key, vtype, vstr, vint FROM k JOIN live USING (trace_id, span_id)""")
def gt6_span_prefix_allowlist(spark, sf_dir):
    """Namespace-prefix allowlist over resource, span and event attributes of every turn span;
    spans left with no span or event attributes are dropped (GT7)."""
    from tracefold.operators import gates
    from tracefold.schemas import explode_attrs
    g = gates.guard_spans(T.turn_spans(spark, sf_dir))
    res = explode_attrs(g, ["trace_id", "span_id"], "resource_attrs").withColumn("scope", F.lit("resource"))
    spn = explode_attrs(g, ["trace_id", "span_id"], "attrs").withColumn("scope", F.lit("span"))
    ev = (g.select("trace_id", "span_id", F.explode("events").alias("e")).select("trace_id", "span_id", "e.attrs")
           .transform(lambda d: explode_attrs(d, ["trace_id", "span_id"], "attrs")).withColumn("scope", F.lit("event")))
    cols = ["trace_id", "span_id", "scope", "key", "vtype", "vstr", "vint"]
    return res.select(*cols).unionByName(spn.select(*cols)).unionByName(ev.select(*cols))


@register("gt7_span_drop_rule", with_views("turn_span_attrs", extra=(("k", f"""
SELECT * FROM turn_span_attrs WHERE {_prefix_sql('key')}"""),)) + """
SELECT role, count(DISTINCT span_id) FILTER (WHERE span_id IN (SELECT span_id FROM k WHERE scope IN ('span', 'event'))) AS kept_spans,
       count(DISTINCT span_id) AS input_spans
FROM turn_span_attrs GROUP BY role""")
def gt7_span_drop_rule(spark, sf_dir):
    """Spans kept per role after the prefix allowlist (system turns carry only foreign attributes)."""
    from tracefold.operators import gates
    sp = T.turn_spans(spark, sf_dir)
    role = F.when(F.col("attrs")["decision.role"].isNotNull(), F.col("attrs")["decision.role"]["s"]).otherwise("system")
    sp = sp.withColumn("role", role)
    kept = gates.guard_spans(sp).groupBy("role").agg(F.count(F.lit(1)).alias("kept_spans"))
    total = sp.groupBy("role").agg(F.count(F.lit(1)).alias("input_spans"))
    return total.join(kept, "role", "left").select("role", F.coalesce("kept_spans", F.lit(0)).alias("kept_spans"),
                                                  "input_spans")
