"""Registered per-decision and red-team jobs (AG1-AG6, WN1, WN2, WN9, ST1, ST2, SC6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.operators import decisions, rails, redteam
from tracefold.plans.oracle_views import with_views
from tracefold.plans.q_text import TENANT_KEY, _chain_sql
from tracefold.plans.registry import register
from tracefold.sources import tables as T


# --------------------------------------------------------------------------- AG1 / AG2
@register("ag1_retrieval_rollup", with_views("retrievals") + """
SELECT decision_id, count(*) AS retrieval_count, array_to_string(list_sort(list_distinct(list(source))), ',') AS retrieval_sources
FROM retrievals GROUP BY decision_id""")
def ag1_retrieval_rollup(spark, sf_dir):
    return decisions.retrieval_rollup(T.retrievals(spark, sf_dir))


@register("ag2_memory_rollup", with_views("memories") + """
SELECT decision_id, count(*) AS memory_write_count, array_to_string(list_sort(list_distinct(list(kind))), ',') AS memory_kinds
FROM memories GROUP BY decision_id""")
def ag2_memory_rollup(spark, sf_dir):
    return decisions.memory_rollup(T.memories(spark, sf_dir))


# --------------------------------------------------------------------------- AG3
def turn_guard_events(spark, sf_dir):
    """Guardrail chain outcome per turn, keyed by the decision (assistant turn) it belongs to."""
    t = T.turns(spark, sf_dir).filter(F.col("role").isin("user", "assistant"))
    t = t.withColumn("phase", F.when(F.col("role") == "user", "input").otherwise("output_final"))
    g = rails.guard_text(t, "text", F.col("phase"), TENANT_KEY)
    return g.select("session_id", (F.col("turn") + F.when(F.col("phase") == "input", 1).otherwise(0))
                    .alias("decision_turn"), "guard.blocked", "guard.entities", "guard.policies")


@register("ag3_guardrail_rollup", with_views("turns", extra=(("g", _chain_sql()), ("e", f"""
SELECT session_id, turn + CASE WHEN phase = 'input' THEN 1 ELSE 0 END AS decision_turn, hit, cat,
       list_filter(['pii:' || cat, CASE WHEN hit THEN 'rail:{C.JAILBREAK_RAIL}' END], lambda x: x IS NOT NULL) AS pol
FROM g"""), ("ent", """
SELECT session_id, decision_turn, string_agg(cat || ':' || CAST(n AS VARCHAR), ',' ORDER BY cat) AS entities
FROM (SELECT session_id, decision_turn, cat, count(*) AS n FROM e WHERE cat IS NOT NULL GROUP BY ALL) GROUP BY ALL"""))) + """
SELECT e.session_id, e.decision_turn, count(*) AS guardrail_events, bool_or(hit) AS blocked,
       coalesce(any_value(ent.entities), '') AS entities,
       array_to_string(list_sort(list_distinct(flatten(list(pol)))), ',') AS policies
FROM e LEFT JOIN ent ON e.session_id = ent.session_id AND e.decision_turn = ent.decision_turn
GROUP BY e.session_id, e.decision_turn""")
def ag3_guardrail_rollup(spark, sf_dir):
    return decisions.guardrail_rollup(turn_guard_events(spark, sf_dir), ["session_id", "decision_turn"])


# --------------------------------------------------------------------------- WN1 / WN2
def _first_wins_sql(flag: str, prefix: str) -> str:
    return with_views("guard_events") + f"""
SELECT decision_id, max(CASE WHEN rn = 1 THEN event_id END) AS {prefix}_event_id,
       max(CASE WHEN rn = 1 THEN ts END) AS {prefix}_ts, count(*) - 1 AS violations
FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY ts, event_id) AS rn
      FROM guard_events WHERE {flag}) GROUP BY decision_id"""


@register("wn1_first_wins_block", _first_wins_sql("blocked", "canonical"))
def wn1_first_wins_block(spark, sf_dir):
    g = T.guard_events(spark, sf_dir)
    return decisions.first_wins(g, ["decision_id"], F.col("blocked"), ["ts", "event_id"], "event_id", "canonical")


@register("wn2_first_wins_escalation", _first_wins_sql("escalated", "canonical"))
def wn2_first_wins_escalation(spark, sf_dir):
    g = T.guard_events(spark, sf_dir)
    return decisions.first_wins(g, ["decision_id"], F.col("escalated"), ["ts", "event_id"], "event_id", "canonical")


# --------------------------------------------------------------------------- AG4-AG6
_SEV_RANK_SQL = "CASE WHEN score >= 0.9 THEN 4 WHEN score >= 0.75 THEN 3 WHEN score >= 0.5 THEN 2 END"
_PROBES_SQL = f"""
SELECT run_id, suite, probe, CASE WHEN findings > 0 THEN 'fail' ELSE 'pass' END AS verdict, attempts, findings,
       duration_ms, ['info', 'low', 'medium', 'high', 'critical'][worst + 1] AS worst_severity
FROM (SELECT run_id, suite, probe, count(*) AS attempts, count(*) FILTER (WHERE score >= 0.5) AS findings,
             CAST(sum(latency_ms) AS BIGINT) AS duration_ms, max({_SEV_RANK_SQL}) AS worst
      FROM attempts GROUP BY ALL)"""


def probes_frame(spark, sf_dir):
    return redteam.probe_verdicts(T.attempts(spark, sf_dir))


@register("ag4_probe_verdict", with_views("attempts") + _PROBES_SQL)
def ag4_probe_verdict(spark, sf_dir):
    return probes_frame(spark, sf_dir)


@register("ag5_worst_score", with_views("attempt_scores") + """
SELECT attempt_id, CAST(score AS DOUBLE) AS worst_score, scorer AS worst_scorer FROM (
  SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY score DESC, pos) AS rn FROM attempt_scores)
WHERE rn = 1""")
def ag5_worst_score(spark, sf_dir):
    return redteam.worst_score(T.attempt_scores(spark, sf_dir))


_RUNS_SQL = f"""
SELECT p.run_id, p.probe_count, p.fail_count, p.duration_ms,
       coalesce(s.n_info, 0) AS n_info, coalesce(s.n_low, 0) AS n_low, coalesce(s.n_medium, 0) AS n_medium,
       coalesce(s.n_high, 0) AS n_high, coalesce(s.n_critical, 0) AS n_critical
FROM (SELECT run_id, count(*) AS probe_count, count(*) FILTER (WHERE verdict = 'fail') AS fail_count,
             CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM probes GROUP BY run_id) p
LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE r = 0) AS n_info, count(*) FILTER (WHERE r = 1) AS n_low, count(*) FILTER (WHERE r = 2) AS n_medium,
                  count(*) FILTER (WHERE r = 3) AS n_high, count(*) FILTER (WHERE r = 4) AS n_critical
           FROM (SELECT run_id, {_SEV_RANK_SQL} AS r FROM attempts WHERE score >= 0.5) GROUP BY run_id) s
ON p.run_id = s.run_id"""


@register("ag6_run_totals", with_views("attempts", extra=(("probes", _PROBES_SQL),)) + _RUNS_SQL)
def ag6_run_totals(spark, sf_dir):
    return redteam.run_totals(T.attempts(spark, sf_dir), probes_frame(spark, sf_dir))


# --------------------------------------------------------------------------- ST1 / ST2
REQUESTED_SUITES = ["s0", "s1", "s2"]
REQUESTED_PROBES = [(s, f"src{i}") for s in ("s0", "s1") for i in range(22)]


@register("st1_suite_union", with_views("attempts", extra=(("probes", _PROBES_SQL),)) + f"""
SELECT suite, probe, verdict, attempts, findings FROM probes
UNION ALL
SELECT suite, '{C.UNKNOWN_SUITE_PROBE}', 'error', 0, 0
FROM (VALUES {", ".join(f"('{s}')" for s in REQUESTED_SUITES)}) r(suite)
WHERE suite NOT IN (SELECT suite FROM probes)""")
def st1_suite_union(spark, sf_dir):
    return redteam.suite_union(probes_frame(spark, sf_dir), REQUESTED_SUITES)


@register("st2_missing_probes", with_views("attempts", extra=(("probes", _PROBES_SQL),)) + f"""
SELECT r.suite, r.probe, 'error' AS verdict, CAST(0 AS BIGINT) AS attempts, 'info' AS finding_severity
FROM (VALUES {", ".join(f"('{s}', '{p}')" for s, p in REQUESTED_PROBES)}) r(suite, probe)
WHERE NOT EXISTS (SELECT 1 FROM probes p WHERE p.suite = r.suite AND p.probe = r.probe)""")
def st2_missing_probes(spark, sf_dir):
    return redteam.missing_probes(probes_frame(spark, sf_dir), REQUESTED_PROBES)


# --------------------------------------------------------------------------- WN9
@register("wn9_probe_recurrence", with_views("attempts") + """
SELECT a.attempt_id, a.run_id, h.first_run_id, h.n_runs, a.run_id <> h.first_run_id AS is_recurrence
FROM attempts a JOIN (SELECT prompt_hash, min(run_id) AS first_run_id, count(DISTINCT run_id) AS n_runs
                      FROM attempts GROUP BY prompt_hash) h ON a.prompt_hash = h.prompt_hash""")
def wn9_probe_recurrence(spark, sf_dir):
    r = redteam.probe_recurrence(T.attempts(spark, sf_dir))
    return r.select("attempt_id", "run_id", "first_run_id", "n_runs", "is_recurrence")


# --------------------------------------------------------------------------- SC6
@register("sc6_redteam_rows", with_views("attempts", extra=(("probes", _PROBES_SQL), ("runs", _RUNS_SQL))) + """
SELECT 'redteam_run' AS row_class, run_id, NULL::VARCHAR AS suite, NULL::VARCHAR AS probe, NULL::VARCHAR AS verdict,
       probe_count AS count_a, fail_count AS count_b, duration_ms, 'red_team_result' AS allowlist_class FROM runs
UNION ALL
SELECT 'redteam_probe', run_id, suite, probe, verdict, attempts, findings, duration_ms, 'red_team_result' FROM probes""")
def sc6_redteam_rows(spark, sf_dir):
    a = T.attempts(spark, sf_dir)
    probes = redteam.probe_verdicts(a)
    runs = redteam.run_totals(a, probes)
    return redteam.emit_rows(runs, probes)
