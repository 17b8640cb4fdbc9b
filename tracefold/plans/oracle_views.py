"""DuckDB twins of the stand-in views in ``tracefold.sources.tables``.

Each oracle query is ``WITH <views it needs> <query>``; ``with_views`` builds
the prefix. The driver tables are pre-registered under their own names.
"""

from __future__ import annotations

from tracefold import constants as C

_PHRASE = C.JAILBREAK_PHRASES[0]

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_view("records", (), """
SELECT event_id AS decision_id, ts, user_id,
       't-' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
       'a-' || CAST(user_id % 20 AS VARCHAR) AS agent_id,
       CASE WHEN event_type IN ('view', 'click') THEN 'decision_summary'
            WHEN event_type = 'purchase' THEN 'cost_usage_aggregate'
            WHEN event_type = 'error' THEN 'escalation'
            ELSE 'unlisted_class' END AS event_class,
       'm-' || CAST(event_id % 4 AS VARCHAR) AS model,
       CAST(value / 1000 AS DECIMAL(18,6)) AS cost_usd,
       CAST(floor(value) AS BIGINT) AS latency_ms,
       event_id % 1000 AS input_tokens,
       event_id % 700 AS output_tokens,
       CASE WHEN event_id % 29 = 1 THEN props || ' mail user' || CAST(user_id AS VARCHAR) || '@example.com '
            WHEN event_id % 29 = 2 THEN repeat('note ', 2000) ELSE props END AS internal_note
FROM events""")

# Row form of the packed attribute map: one row per non-null attribute.
_view("record_attrs", ("records",), """
SELECT decision_id, event_class, key, vtype, vstr, vint, vdbl FROM (
  SELECT decision_id, event_class, 'event_class' AS key, 'str' AS vtype, event_class AS vstr, NULL::BIGINT AS vint, NULL::DOUBLE AS vdbl FROM records
  UNION ALL SELECT decision_id, event_class, 'tenant_id', 'str', tenant_id, NULL, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'agent_id', 'str', agent_id, NULL, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'decision_id', 'int', NULL, decision_id, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'model', 'str', model, NULL, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'cost_usd', 'double', NULL, NULL, CAST(cost_usd AS DOUBLE) FROM records
  UNION ALL SELECT decision_id, event_class, 'latency_ms', 'int', NULL, latency_ms, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'input_tokens', 'int', NULL, input_tokens, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'output_tokens', 'int', NULL, output_tokens, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'internal_note', 'str', internal_note, NULL, NULL FROM records
  UNION ALL SELECT decision_id, event_class, 'user_id', 'int', NULL, user_id, NULL FROM records
) WHERE vstr IS NOT NULL OR vint IS NOT NULL OR vdbl IS NOT NULL""")

_view("identities", ("records",), """
SELECT decision_id, CASE decision_id % 19 WHEN 1 THEN chr(8195) || ' ' || tenant_id || chr(9) WHEN 2 THEN ' ' || chr(10) || chr(160)
                                          WHEN 3 THEN '' ELSE tenant_id END AS tenant_id,
       CASE decision_id % 19 WHEN 4 THEN agent_id || '  ' WHEN 5 THEN NULL ELSE agent_id END AS agent_id
FROM records""")

_view("texts", (), f"""
SELECT doc_id, 'decision_summary.text' AS path,
       CASE doc_id % 23 WHEN 1 THEN text || ' {_PHRASE.upper()}'
                        WHEN 2 THEN chr(8195) || '  ' || text || ' ' || chr(9) || chr(10)
                        WHEN 3 THEN repeat('long text ', 7000)
                        WHEN 4 THEN text || ' 415-555-0134' ELSE text END AS value, lang, source FROM documents""")

_view("turns", (), f"""
SELECT conv_id AS session_id, turn, role,
       CASE WHEN k = 1 THEN text || chr(10) || '{_PHRASE.split(" ", 1)[0]}' || chr(10) || '{_PHRASE.split(" ", 1)[1]}'
            WHEN k = 2 THEN text || ' {_PHRASE}'
            WHEN k = 3 AND role = 'assistant' THEN text || ' write to help.desk@example.org'
            WHEN k = 4 THEN text || ' 415-555-0134'
            WHEN k = 5 THEN chr(8195) || ' ' || text || chr(10) || ' ' ELSE text END AS text
FROM (SELECT *, (conv_id * 3 + turn) % 17 AS k FROM conversations)""")

_view("scores", (), """
SELECT l.doc_id AS decision_id,
       CASE WHEN l.toxic = 1 THEN 'harmlessness' ELSE 'groundedness' END AS rubric,
       CAST(CAST(l.doc_id * 37 % 100 AS DECIMAL(9,0)) / 100 AS DECIMAL(9,2)) AS score,
       CASE WHEN l.quality = 1 THEN 'fast' ELSE 'deep' END AS tier,
       't-' || CAST(l.doc_id % 5 AS VARCHAR) AS tenant_id,
       'a-' || CAST(l.doc_id % 20 AS VARCHAR) AS agent_id,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(l.doc_id * 37 AS BIGINT)) AS ts,
       d.n_chars AS output_length,
       d.source
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")

_view("attempts", (), """
SELECT 'run-' || CAST(doc_id % 3 AS VARCHAR) AS run_id,
       's' || CAST(doc_id % 2 AS VARCHAR) AS suite,
       source AS probe,
       doc_id AS attempt_id,
       CAST(CAST(doc_id * 7919 % 1000 AS DECIMAL(9,0)) / 1000 AS DECIMAL(9,3)) AS score,
       sha256(text) AS prompt_hash,
       n_chars % 997 AS latency_ms,
       text AS prompt
FROM documents""")

_view("attempt_scores", (), """
SELECT doc_id AS attempt_id, CAST(pos AS BIGINT) AS pos,
       ['refusal', 'harm', 'leak'][pos + 1] AS scorer,
       CAST(CAST((doc_id * 31 + pos * 17) % 10 AS DECIMAL(9,0)) / 10 AS DECIMAL(9,1)) AS score
FROM documents, range(0, 3) r(pos)""")

_view("retrievals", (), """
SELECT event_id - event_id % 3 AS decision_id, event_id, ts,
       CASE WHEN event_id % 13 = 0 THEN 'web'
            ELSE ['rag', 'kg', 'sql', 'tool', 'memory', 'document', 'hybrid'][event_id % 7 + 1] END AS source,
       CASE WHEN event_id % 11 = 0 THEN 'not-a-hash'
            ELSE sha256(CAST(event_id % 50 AS VARCHAR)) END AS query_hash,
       event_id % 6 AS result_count,
       CASE WHEN event_id % 4 = 0 THEN event_id % 5 END AS n_result_hashes,
       't-' || CAST(user_id % 5 AS VARCHAR) AS tenant_id
FROM events WHERE event_type = 'click'""")

_view("memories", (), """
SELECT event_id - event_id % 3 AS decision_id, event_id, ts,
       ['episodic', 'semantic', 'scratch'][user_id % 3 + 1] AS kind,
       sha256(props) AS content_hash,
       CASE WHEN event_id % 2 = 0 THEN (event_id % 5 + 1) * 86400 END AS ttl_seconds
FROM events WHERE event_type = 'signup'""")

_view("escalations", ("records",), """
SELECT 'esc-' || CAST(decision_id AS VARCHAR) AS escalation_id, decision_id, tenant_id, agent_id,
       ts AS requested_at, ts + INTERVAL 4 HOUR AS deadline,
       ['sync', 'async', 'deferred'][decision_id % 3 + 1] AS mode,
       ['fail-closed', 'defer', 'fail-open'][user_id % 3 + 1] AS fallback,
       decision_id % 3 + 1 AS required_rank
FROM records WHERE event_class = 'escalation'""")

_view("reviews", ("escalations",), """
SELECT * FROM (
  WITH b0 AS (
    SELECT escalation_id, decision_id, requested_at + to_hours(CAST(decision_id % 13 AS BIGINT)) AS given_at
    FROM escalations WHERE decision_id % 3 = 0),
  b AS (
    SELECT CASE WHEN decision_id % 21 = 0 THEN 'none-' || CAST(decision_id AS VARCHAR) ELSE escalation_id END AS escalation_id, decision_id,
           'n-' || CAST(decision_id AS VARCHAR) AS nonce,
           ['approve', 'reject', 'modify'][(decision_id // 3) % 3 + 1] AS verdict,
           'rev-' || CAST(decision_id % 7 AS VARCHAR) AS reviewer_id,
           (decision_id // 3) % 4 AS reviewer_rank, given_at AS reviewed_at,
           given_at + CASE WHEN decision_id % 27 = 0 THEN INTERVAL 8 DAY ELSE INTERVAL 0 DAY END AS received_at
    FROM b0)
  SELECT * FROM b
  UNION ALL
  SELECT escalation_id, decision_id, 'n-' || CAST(decision_id AS VARCHAR) || '-b',
         ['approve', 'reject', 'modify'][((decision_id // 3) + 1) % 3 + 1],
         'rev-' || CAST((decision_id + 1) % 7 AS VARCHAR), CAST(3 AS BIGINT),
         given_at + INTERVAL 1 HOUR, given_at + INTERVAL 1 HOUR
  FROM b0 WHERE decision_id % 9 = 0
  UNION ALL
  SELECT escalation_id, decision_id, nonce || '-c', verdict, reviewer_id, reviewer_rank,
         reviewed_at + INTERVAL 30 MINUTE, reviewed_at + INTERVAL 30 MINUTE
  FROM b WHERE decision_id % 15 = 0
  UNION ALL
  SELECT * FROM b WHERE decision_id % 18 = 0)""")

# Verdicts that may answer their escalation.
_view("qualified", ("reviews", "escalations"), f"""
SELECT r.* FROM reviews r JOIN escalations e ON r.escalation_id = e.escalation_id
WHERE r.reviewer_rank >= e.required_rank AND date_diff('second', r.reviewed_at, r.received_at) <= {C.STALE_VERDICT_DAYS} * 86400
  AND (e.fallback = 'defer' OR r.reviewed_at <= e.deadline)""")

_view("vectors", (), """
SELECT vec_id, embedding, label FROM embeddings""")

_view("decision_flags", ("records",), """
SELECT decision_id, tenant_id, agent_id, ts,
       latency_ms % 7 = 0 AS blocked,
       event_class = 'escalation' AS escalated,
       CASE WHEN latency_ms % 11 = 0 THEN 'TimeoutError' END AS exception
FROM records""")

_view("guard_events", (), """
SELECT event_id - event_id % 3 AS decision_id, event_id, ts, value > 200 AS blocked,
       event_type = 'error' AS escalated, 'rail:r' || CAST(user_id % 4 AS VARCHAR) AS policy
FROM events""")

_view("fetches", (), """
SELECT 'rev-' || CAST(user_id % 7 AS VARCHAR) AS reviewer_id, ts, event_id AS fetch_id
FROM events WHERE event_type = 'view'""")

_view("arrivals", (), """
SELECT event_id, ts, user_id, ts + to_seconds(CAST(event_id * 7919 % 600 AS BIGINT)) AS arrived_at FROM events""")

# Row form of the stand-in spans: (trace_id, span_id, scope, key, vtype, vstr, vint).
_view("turn_span_attrs", (), """
SELECT * FROM (
  SELECT lpad(lower(hex(conv_id)), 32, '0') AS trace_id, lpad(lower(hex(conv_id * 1000 + turn)), 16, '0') AS span_id,
         role, 'span' AS scope, 'decision.session_id' AS key, 'int' AS vtype, NULL::VARCHAR AS vstr,
         CASE WHEN role <> 'system' THEN conv_id END AS vint FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'span',
         'decision.role', 'str', CASE WHEN role <> 'system' THEN role END, NULL FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'span',
         'gen_ai.output_chars', 'int', NULL, CASE WHEN role <> 'system' THEN length(text) END FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'span',
         'user.text', 'str', text, NULL FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'span',
         'decisionx.spoof', 'str', '1', NULL FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'resource',
         'service.name', 'str', 'agent-' || CAST(conv_id % 3 AS VARCHAR), NULL FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'resource',
         'host.name', 'str', 'h' || CAST(conv_id % 5 AS VARCHAR), NULL FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'event',
         'decision.guardrail.phase', 'str',
         CASE WHEN role = 'user' THEN 'input' WHEN role <> 'system' THEN 'output_final' END, NULL FROM conversations
  UNION ALL SELECT lpad(lower(hex(conv_id)), 32, '0'), lpad(lower(hex(conv_id * 1000 + turn)), 16, '0'), role, 'event',
         'k8s.pod', 'str', 'p-1', NULL FROM conversations
) WHERE vstr IS NOT NULL OR vint IS NOT NULL""")

# What the stand-in trace requests say, one row per assistant turn (nulls: attribute not set).
_view("turn_calls", (), """
SELECT conv_id, turn, k, chars, lpad(lower(hex(conv_id)), 32, '0') AS trace_id,
       lpad(lower(hex((conv_id * 1000 + turn) * 10)), 16, '0') AS span_id,
       lpad(lower(hex((conv_id * 1000 + turn) * 10 + 1)), 16, '0') AS llm_id,
       lpad(lower(hex((conv_id * 1000 + turn) * 10 + 2)), 16, '0') AS tool_id,
       lpad(lower(hex((conv_id * 1000 + turn) * 10 + 9)), 16, '0') AS lost_id,
       't-' || CAST(conv_id % 5 AS VARCHAR) AS tenant_id, 'a-' || CAST(conv_id % 20 AS VARCHAR) AS agent_id,
       k % 900 + 1 AS latency_ms,
       CASE WHEN k % 3 <> 0 THEN 'm-' || CAST(k % 4 AS VARCHAR) ELSE 'm-' || CAST(k % 4 + 1 AS VARCHAR) END AS model,
       CASE WHEN k % 2 = 0 THEN chars % 300 ELSE chars % 300 + 1 END AS input_tokens,
       chars % 200 + 2 AS output_tokens
FROM (SELECT *, conv_id + turn AS k, length(text) AS chars FROM conversations WHERE role = 'assistant')""")

_view("deliveries", ("guard_events",), """
SELECT decision_id, event_id, ts AS arrived_at, blocked FROM guard_events
UNION ALL SELECT decision_id, event_id, ts + INTERVAL 30 SECOND, blocked FROM guard_events WHERE event_id % 5 = 0""")


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(*names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """``WITH`` prefix defining ``names`` (and their dependencies) plus extra CTEs."""
    parts = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _order(names)]
    parts += [f"{n} AS ({sql.strip()})" for n, sql in extra]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
