"""Registered graph, ordering and similarity jobs (JN3-JN6, JN11, JN13, AG13, ST3, WN3-WN5, WN10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import decisions, erasure, graph, ordering
from tracefold.plans.oracle_views import with_views
from tracefold.plans.registry import register
from tracefold.sources import tables as T


# --------------------------------------------------------------------------- edge producers
def session_decisions(spark, sf_dir):
    """Assistant turns as decisions, with their position and predecessor in the session."""
    t = T.turns(spark, sf_dir).filter(F.col("role") == "assistant").select("session_id", "turn")
    return ordering.sequence_within(t, ["session_id"], "turn", rank_col="decision_seq",
                                    prev_col="prev_turn", next_col="next_turn")


def _did(session: F.Column, turn: F.Column) -> F.Column:
    return F.concat(F.lit("s"), session.cast("string"), F.lit(":t"), turn.cast("string"))


def session_turns(spark, sf_dir):
    """Turns with their neighbours in the session, the session's user, and for assistant turns the decision's predecessor."""
    t = T.turns(spark, sf_dir)
    seq = ordering.sequence_within(t.select("session_id", "turn"), ["session_id"], "turn", rank_col="seq", prev_col="before", next_col="after")
    return t.join(seq.select("session_id", "turn", "before", "after"), ["session_id", "turn"])


def sources(spark, sf_dir):
    """Every producer of the graph: what each row of a table tells about edges and nodes."""
    c = F.col
    did, text = c("decision_id").cast("string"), lambda *x: F.concat(*[v if isinstance(v, F.Column) else F.lit(v) for v in x])
    hashed = lambda col: F.sha2(col.cast("string"), 256)
    user = hashed(c("user_id"))
    here, sid = _did(c("session_id"), c("turn")), text("s", c("session_id").cast("string"))
    assistant = c("role") == "assistant"
    step = text("step:", c("session_id").cast("string"), ":", c("turn").cast("string"))
    after = text("step:", c("session_id").cast("string"), ":", c("after").cast("string"))
    judge = F.concat_ws(":", did, c("rubric"))
    decided = c("event_class") == "decision_summary"
    return [
        graph.Source(T.records(spark, sf_dir), [
            graph.Edge("produced_by", did, c("agent_id"), c("ts"), decided),
        ], [
            graph.Node("Decision", did, {"model": c("model"), "latency_ms": c("latency_ms"), "cost_usd": c("cost_usd"), "tenant_id": c("tenant_id")}, decided),
            graph.Node("Agent", c("agent_id"), {"name": c("agent_id")}),
            graph.Node("Tenant", c("tenant_id"), {"name": c("tenant_id")}),
            graph.Node("User", user, {}),
        ]),
        graph.Source(T.retrievals(spark, sf_dir), [
            graph.Edge("retrieved", did, c("event_id"), c("ts")),
            graph.Edge("referenced_entity", c("event_id"), text("e:", c("query_hash")), c("ts"), c("source") == "kg"),
        ], [
            graph.Node("Retrieval", c("event_id"), {"source": c("source"), "query_hash": c("query_hash"), "result_count": c("result_count")}),
            graph.Node("Entity", text("e:", c("query_hash")), {}, c("source") == "kg"),
        ]),
        graph.Source(T.scores(spark, sf_dir), [graph.Edge("judged_by", did, judge, c("ts"))],
                     [graph.Node("Judge", judge, {"rubric": c("rubric"), "score": c("score"), "tier": c("tier")})]),
        graph.Source(T.escalations(spark, sf_dir), [graph.Edge("escalated", did, c("escalation_id"), c("requested_at"))],
                     [graph.Node("Escalation", c("escalation_id"), {"mode": c("mode"), "fallback": c("fallback")})]),
        graph.Source(T.reviews(spark, sf_dir), [
            graph.Edge("reviewed_by", did, c("nonce"), c("reviewed_at")),
            graph.Edge("resolved_by", c("escalation_id"), c("nonce"), c("reviewed_at")),
        ], [graph.Node("Review", c("nonce"), {"reviewer_id": c("reviewer_id"), "verdict": c("verdict")})]),
        graph.Source(T.guard_events(spark, sf_dir), [graph.Edge("triggered", did, text("g:", c("event_id").cast("string")), c("ts"), c("blocked"))],
                     [graph.Node("Guardrail", text("g:", c("event_id").cast("string")), {"policy_id": c("policy"), "action": F.lit("block")}, c("blocked"))]),
        graph.Source(session_turns(spark, sf_dir), [
            graph.Edge("in_session", here, sid, when=assistant),
            graph.Edge("for_user", sid, hashed(c("session_id")), when=c("before").isNull()),
            graph.Edge("has_input", here, text("in:", hashed(text(sid, ":", c("before").cast("string")))), when=assistant & c("before").isNotNull()),
            graph.Edge("has_output", here, text("out:", hashed(here)), when=assistant),
            graph.Edge("stepped", here, step, when=assistant),
            graph.Edge("next_step", step, after, when=c("after").isNotNull()),
        ], [
            graph.Node("Session", sid, {"user_id_hash": hashed(c("session_id"))}),
            graph.Node("User", hashed(c("session_id")), {}),
            graph.Node("Decision", here, {"session": sid}, assistant),
            graph.Node("Input", text("in:", hashed(text(sid, ":", c("turn").cast("string")))), {"content_hash": hashed(c("text")), "length": F.length("text")}, c("after").isNotNull()),
            graph.Node("Output", text("out:", hashed(here)), {"content_hash": hashed(c("text")), "length": F.length("text")}, assistant),
            graph.Node("Step", step, {"role": c("role")}),
        ]),
        graph.Source(session_decisions(spark, sf_dir), [graph.Edge("preceded_by", here, _did(c("session_id"), c("prev_turn")), when=c("prev_turn").isNotNull())]),
    ]


def edge_table(spark, sf_dir, types=None):
    return graph.build_edges(sources(spark, sf_dir), types)


_SEQ = ("seq", """
SELECT session_id, turn, role, text, 's' || CAST(session_id AS VARCHAR) AS sid, 's' || CAST(session_id AS VARCHAR) || ':t' || CAST(turn AS VARCHAR) AS did,
       'step:' || CAST(session_id AS VARCHAR) || ':' AS step, lag(turn) OVER w AS before, lead(turn) OVER w AS after
FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn)""")
_EDGES_SQL = """
SELECT 'produced_by' AS edge_type, 'Decision' AS from_type, CAST(decision_id AS VARCHAR) AS from_id, 'Agent' AS to_type,
       agent_id AS to_id, ts FROM records WHERE event_class = 'decision_summary'
UNION ALL SELECT 'retrieved', 'Decision', CAST(decision_id AS VARCHAR), 'Retrieval', CAST(event_id AS VARCHAR), ts FROM retrievals
UNION ALL SELECT 'referenced_entity', 'Retrieval', CAST(event_id AS VARCHAR), 'Entity', 'e:' || query_hash, ts FROM retrievals WHERE source = 'kg'
UNION ALL SELECT 'judged_by', 'Decision', CAST(decision_id AS VARCHAR), 'Judge', CAST(decision_id AS VARCHAR) || ':' || rubric, ts FROM scores
UNION ALL SELECT 'escalated', 'Decision', CAST(decision_id AS VARCHAR), 'Escalation', escalation_id, requested_at FROM escalations
UNION ALL SELECT 'reviewed_by', 'Decision', CAST(decision_id AS VARCHAR), 'Review', nonce, reviewed_at FROM reviews
UNION ALL SELECT 'resolved_by', 'Escalation', escalation_id, 'Review', nonce, reviewed_at FROM reviews
UNION ALL SELECT 'triggered', 'Decision', CAST(decision_id AS VARCHAR), 'Guardrail', 'g:' || CAST(event_id AS VARCHAR), ts FROM guard_events WHERE blocked
UNION ALL SELECT 'in_session', 'Decision', did, 'Session', sid, NULL::TIMESTAMP FROM seq WHERE role = 'assistant'
UNION ALL SELECT 'for_user', 'Session', sid, 'User', sha256(CAST(session_id AS VARCHAR)), NULL::TIMESTAMP FROM seq WHERE before IS NULL
UNION ALL SELECT 'has_input', 'Decision', did, 'Input', 'in:' || sha256(sid || ':' || CAST(before AS VARCHAR)), NULL::TIMESTAMP
  FROM seq WHERE role = 'assistant' AND before IS NOT NULL
UNION ALL SELECT 'has_output', 'Decision', did, 'Output', 'out:' || sha256(did), NULL::TIMESTAMP FROM seq WHERE role = 'assistant'
UNION ALL SELECT 'stepped', 'Decision', did, 'Step', step || CAST(turn AS VARCHAR), NULL::TIMESTAMP FROM seq WHERE role = 'assistant'
UNION ALL SELECT 'next_step', 'Step', step || CAST(turn AS VARCHAR), 'Step', step || CAST(after AS VARCHAR), NULL::TIMESTAMP FROM seq WHERE after IS NOT NULL
UNION ALL SELECT 'preceded_by', 'Decision', did, 'Decision', sid || ':t' || CAST(prev AS VARCHAR), NULL::TIMESTAMP
  FROM (SELECT *, lag(turn) OVER (PARTITION BY session_id ORDER BY turn) AS prev FROM seq WHERE role = 'assistant') WHERE prev IS NOT NULL"""

_GRAPH_VIEWS = ("records", "retrievals", "scores", "escalations", "reviews", "turns", "guard_events")


@register("st3_edge_union", with_views(*_GRAPH_VIEWS, extra=(_SEQ,)) + _EDGES_SQL)
def st3_edge_union(spark, sf_dir):
    """All fifteen edge types in one table."""
    return edge_table(spark, sf_dir)


@register("jn3_graph_build", with_views(*_GRAPH_VIEWS, extra=(_SEQ, ("e", _EDGES_SQL))) + """
SELECT node_type, node_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT from_type AS node_type, from_id AS node_id, 1 AS o, 0 AS i FROM e
  UNION ALL SELECT to_type, to_id, 0, 1 FROM e) GROUP BY ALL""")
def jn3_graph_build(spark, sf_dir):
    return graph.nodes_from_edges(edge_table(spark, sf_dir))


def _facts(node_type: str, node_id: str, where: str, **props: str) -> str:
    pairs = ", ".join(f"{{'name': '{k}', 'value': CAST({v} AS VARCHAR)}}" for k, v in props.items())
    facts = f"[{pairs}]" if props else "[{'name': NULL::VARCHAR, 'value': NULL::VARCHAR}]"
    return f"SELECT '{node_type}' AS node_type, CAST({node_id} AS VARCHAR) AS node_id, unnest({facts}) AS f FROM {where}"


@register("jn3_node_tables", with_views(*_GRAPH_VIEWS, extra=(_SEQ, ("facts", " UNION ALL ".join([
    _facts("Decision", "decision_id", "records WHERE event_class = 'decision_summary'", model="model", latency_ms="latency_ms", cost_usd="cost_usd", tenant_id="tenant_id"),
    _facts("Agent", "agent_id", "records", name="agent_id"), _facts("Tenant", "tenant_id", "records", name="tenant_id"),
    _facts("User", "sha256(CAST(user_id AS VARCHAR))", "records"),
    _facts("Retrieval", "event_id", "retrievals", source="source", query_hash="query_hash", result_count="result_count"),
    _facts("Entity", "'e:' || query_hash", "retrievals WHERE source = 'kg'"),
    _facts("Judge", "CAST(decision_id AS VARCHAR) || ':' || rubric", "scores", rubric="rubric", score="score", tier="tier"),
    _facts("Escalation", "escalation_id", "escalations", mode="mode", fallback="fallback"),
    _facts("Review", "nonce", "reviews", reviewer_id="reviewer_id", verdict="verdict"),
    _facts("Guardrail", "'g:' || CAST(event_id AS VARCHAR)", "guard_events WHERE blocked", policy_id="policy", action="'block'"),
    _facts("Session", "sid", "seq", user_id_hash="sha256(CAST(session_id AS VARCHAR))"), _facts("User", "sha256(CAST(session_id AS VARCHAR))", "seq"),
    _facts("Decision", "did", "seq WHERE role = 'assistant'", session="sid"),
    _facts("Input", "'in:' || sha256(sid || ':' || CAST(turn AS VARCHAR))", "seq WHERE after IS NOT NULL", content_hash="sha256(text)", length="length(text)"),
    _facts("Output", "'out:' || sha256(did)", "seq WHERE role = 'assistant'", content_hash="sha256(text)", length="length(text)"),
    _facts("Step", "step || CAST(turn AS VARCHAR)", "seq", role="role"),
])), ("per", """
SELECT node_type, node_id, f.name AS name, max(f.value) AS value FROM facts GROUP BY ALL"""))) + """
SELECT node_type, node_id,
       '{' || coalesce(string_agg('"' || name || '":"' || value || '"', ',' ORDER BY name) FILTER (WHERE value IS NOT NULL), '') || '}' AS props
FROM per GROUP BY node_type, node_id""")
def jn3_node_tables(spark, sf_dir):
    """One row per node with its properties as JSON."""
    return graph.build_nodes(sources(spark, sf_dir))


# --------------------------------------------------------------------------- JN4
@register("jn4_decision_subgraph", with_views("records", "retrievals", "scores", "escalations") + """
SELECT d.decision_id, d.agent_id, d.model, CAST(d.cost_usd AS DOUBLE) AS cost_usd, d.latency_ms,
       coalesce(r.retrieval_count, 0) AS retrieval_count, coalesce(r.retrieval_sources, '') AS retrieval_sources,
       coalesce(s.judge_count, 0) AS judge_count, s.min_score, coalesce(e.escalation_count, 0) AS escalation_count
FROM records d
LEFT JOIN (SELECT decision_id, count(*) AS retrieval_count,
                  array_to_string(list_sort(list_distinct(list(source))), ',') AS retrieval_sources
           FROM retrievals GROUP BY decision_id) r ON d.decision_id = r.decision_id
LEFT JOIN (SELECT decision_id, count(*) AS judge_count, CAST(min(score) AS DOUBLE) AS min_score
           FROM scores GROUP BY decision_id) s ON d.decision_id = s.decision_id
LEFT JOIN (SELECT decision_id, count(*) AS escalation_count FROM escalations GROUP BY decision_id) e
       ON d.decision_id = e.decision_id
WHERE d.event_class = 'decision_summary'""")
def jn4_decision_subgraph(spark, sf_dir):
    """Decision-scoped read: one flat row per decision with its retrievals, judges and escalations."""
    d = T.records(spark, sf_dir).filter(F.col("event_class") == "decision_summary").select(
        "decision_id", "agent_id", "model", F.col("cost_usd").cast("double").alias("cost_usd"), "latency_ms")
    r = decisions.retrieval_rollup(T.retrievals(spark, sf_dir))
    s = T.scores(spark, sf_dir).groupBy("decision_id").agg(
        F.count(F.lit(1)).alias("judge_count"), F.min("score").cast("double").alias("min_score"))
    e = T.escalations(spark, sf_dir).groupBy("decision_id").agg(F.count(F.lit(1)).alias("escalation_count"))
    j = d.join(r, "decision_id", "left").join(s, "decision_id", "left").join(e, "decision_id", "left")
    return j.select("decision_id", "agent_id", "model", "cost_usd", "latency_ms",
                    F.coalesce("retrieval_count", F.lit(0)).alias("retrieval_count"),
                    F.coalesce("retrieval_sources", F.lit("")).alias("retrieval_sources"),
                    F.coalesce("judge_count", F.lit(0)).alias("judge_count"), "min_score",
                    F.coalesce("escalation_count", F.lit(0)).alias("escalation_count"))


def _list_sql(fields, order: str) -> str:
    body = " || ',' || ".join(f"'\"{n}\":' || {x}" for n, x in fields)
    return f"'[' || string_agg('{{' || {body} || '}}', ',' ORDER BY {order}) || ']'"


def _text(x: str) -> str:
    return f"'\"' || {x} || '\"'"


def _at(x: str) -> str:
    return _text(f"strftime({x}, '%Y-%m-%d %H:%M:%S')")


_NUM = "CAST({} AS VARCHAR)".format


@register("jn4_decision_document", with_views("records", "retrievals", "guard_events", "scores", "reviews", "escalations") + f"""
SELECT d.decision_id, d.tenant_id,
       '{{"decision_id":' || CAST(d.decision_id AS VARCHAR) || ',"agent":{{"id":"' || d.agent_id || '"}},"user":{{"id_hash":"' || sha256(CAST(d.user_id AS VARCHAR))
       || '"}},"metadata":{{"model":"' || d.model || '","latency_ms":' || CAST(d.latency_ms AS VARCHAR) || '}},"retrievals":' || coalesce(r.j, '[]')
       || ',"guardrails":' || coalesce(g.j, '[]') || ',"judges":' || coalesce(s.j, '[]') || ',"reviews":' || coalesce(v.j, '[]')
       || ',"escalations":' || coalesce(e.j, '[]') || '}}' AS document
FROM records d
LEFT JOIN (SELECT decision_id, {_list_sql([("event_id", _NUM("event_id")), ("source", _text("source")), ("result_count", _NUM("result_count"))], "ts, event_id")} AS j
           FROM retrievals GROUP BY decision_id) r ON d.decision_id = r.decision_id
LEFT JOIN (SELECT decision_id, {_list_sql([("event_id", _NUM("event_id")), ("policy", _text("policy")), ("blocked", _NUM("blocked"))], "ts, event_id")} AS j
           FROM guard_events GROUP BY decision_id) g ON d.decision_id = g.decision_id
LEFT JOIN (SELECT decision_id, {_list_sql([("rubric", _text("rubric")), ("score", _text(_NUM("score"))), ("tier", _text("tier"))], "ts, rubric")} AS j
           FROM scores GROUP BY decision_id) s ON d.decision_id = s.decision_id
LEFT JOIN (SELECT decision_id, {_list_sql([("reviewer_id", _text("reviewer_id")), ("verdict", _text("verdict")), ("reviewed_at", _at("reviewed_at"))], "reviewed_at, nonce")} AS j
           FROM reviews GROUP BY decision_id) v ON d.decision_id = v.decision_id
LEFT JOIN (SELECT decision_id, {_list_sql([("escalation_id", _text("escalation_id")), ("mode", _text("mode"))], "requested_at, escalation_id")} AS j
           FROM escalations GROUP BY decision_id) e ON d.decision_id = e.decision_id""")
def jn4_decision_document(spark, sf_dir):
    """The whole subgraph of each decision as one nested document, as canonical JSON."""
    d = nested_documents(spark, sf_dir)
    return d.select("decision_id", "tenant_id", F.to_json(F.struct(*[c for c in d.columns if c != "tenant_id"])).alias("document"))


def nested_documents(spark, sf_dir):
    d = T.records(spark, sf_dir).select(
        "decision_id", "tenant_id", F.struct(F.col("agent_id").alias("id")).alias("agent"),
        F.struct(F.sha2(F.col("user_id").cast("string"), 256).alias("id_hash")).alias("user"), F.struct("model", "latency_ms").alias("metadata"))
    scores = T.scores(spark, sf_dir).withColumn("score", F.col("score").cast("string"))
    reviews = T.reviews(spark, sf_dir).withColumn("at", F.col("reviewed_at")).withColumn("reviewed_at", F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss"))
    return graph.decision_documents(d, {
        "retrievals": graph.Part(T.retrievals(spark, sf_dir), ["event_id", "source", "result_count"], ["ts", "event_id"]),
        "guardrails": graph.Part(T.guard_events(spark, sf_dir), ["event_id", "policy", "blocked"], ["ts", "event_id"]),
        "judges": graph.Part(scores, ["rubric", "score", "tier"], ["ts", "rubric"]),
        "reviews": graph.Part(reviews, ["reviewer_id", "verdict", "reviewed_at"], ["at", "nonce"]),
        "escalations": graph.Part(T.escalations(spark, sf_dir), ["escalation_id", "mode"], ["requested_at", "escalation_id"]),
    })


# --------------------------------------------------------------------------- JN5
JN5_AS_OF = "2024-01-08 00:00:00"


@register("jn5_filtered_graph_query", with_views("records", "scores", "retrievals") + f"""
SELECT decision_id, ts FROM records d
WHERE event_class = 'decision_summary' AND ts >= TIMESTAMP '{JN5_AS_OF}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{JN5_AS_OF}'
  AND EXISTS (SELECT 1 FROM scores s WHERE s.decision_id = d.decision_id AND s.score < 0.7)
  AND EXISTS (SELECT 1 FROM retrievals r WHERE r.decision_id = d.decision_id AND r.source = 'rag')""")
def jn5_filtered_graph_query(spark, sf_dir):
    """Decisions in the last 7 days with a judge score below 0.7 and a retrieval from the RAG corpus."""
    as_of = F.lit(JN5_AS_OF).cast("timestamp_ntz")
    d = T.records(spark, sf_dir).filter((F.col("event_class") == "decision_summary")
                                        & (F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < as_of))
    low = T.scores(spark, sf_dir).filter(F.col("score") < 0.7).select("decision_id")
    rag = T.retrievals(spark, sf_dir).filter(F.col("source") == "rag").select("decision_id")
    return d.join(low, "decision_id", "left_semi").join(rag, "decision_id", "left_semi").select("decision_id", "ts")


# --------------------------------------------------------------------------- JN6
WALK_EDGES = ("preceded_by", "in_session")


@register("jn6_khop_provenance", with_views("turns", extra=(("e", """
SELECT 'in_session' AS edge_type, 'Decision' AS from_type, 's' || CAST(session_id AS VARCHAR) || ':t' || CAST(turn AS VARCHAR) AS from_id,
       'Session' AS to_type, 's' || CAST(session_id AS VARCHAR) AS to_id FROM turns WHERE role = 'assistant'
UNION ALL SELECT 'preceded_by', 'Decision', 's' || CAST(session_id AS VARCHAR) || ':t' || CAST(turn AS VARCHAR), 'Decision',
       's' || CAST(session_id AS VARCHAR) || ':t' || CAST(prev AS VARCHAR)
  FROM (SELECT session_id, turn, lag(turn) OVER (PARTITION BY session_id ORDER BY turn) AS prev
        FROM turns WHERE role = 'assistant') WHERE prev IS NOT NULL"""),)).replace("WITH ", "WITH RECURSIVE ", 1) + """,
r(seed_id, node_type, node_id, hops) AS (
  SELECT from_id, to_type, to_id, 1 FROM e WHERE from_type = 'Decision'
  UNION
  SELECT r.seed_id, e.to_type, e.to_id, r.hops + 1 FROM r JOIN e ON e.from_type = r.node_type AND e.from_id = r.node_id
  WHERE r.hops < 3)
SELECT 'Decision' AS seed_type, seed_id, node_type, node_id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY ALL""")
def jn6_khop_provenance(spark, sf_dir):
    """Everything each session decision reaches in up to 3 hops over preceded_by / in_session edges."""
    e = edge_table(spark, sf_dir, WALK_EDGES)
    seeds = e.filter(F.col("edge_type").isin(*WALK_EDGES) & (F.col("from_type") == "Decision")).select(
        F.col("from_type").alias("seed_type"), F.col("from_id").alias("seed_id")).distinct()
    return graph.walk(e, seeds, 3, follow=WALK_EDGES)


# --------------------------------------------------------------------------- JN11
@register("jn11_erasure_cascade", with_views("records", extra=(("req", """
SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 300"""),)) + """
SELECT d.decision_id, d.user_id, CASE WHEN q.user_id IS NULL THEN d.internal_note END AS internal_note,
       q.user_id IS NOT NULL AS content_deleted
FROM records d LEFT JOIN req q ON d.user_id = q.user_id""")
def jn11_erasure_cascade(spark, sf_dir):
    """Users who asked for erasure lose their content; their decisions stay, flagged."""
    ev = T.read_table(spark, sf_dir, "events")
    req = ev.filter((F.col("event_type") == "signup") & (F.col("value") > 300)).select("user_id")
    rec = T.records(spark, sf_dir).select("decision_id", "user_id", "internal_note")
    return graph.erase_user(rec, req)


ERASED_USERS = (1, 4)
_USER_TURNS = ("ut", """
SELECT session_id, turn, role, text AS content, CASE WHEN role = 'user' THEN session_id % 9 END AS user_id FROM turns""")


@register("jn11_session_cascade", with_views("turns", extra=(_USER_TURNS, ("hit", f"""
SELECT DISTINCT session_id FROM ut WHERE user_id IN {ERASED_USERS}"""))) + f"""
SELECT u.session_id, u.turn, CASE WHEN h.session_id IS NULL THEN u.content END AS content, h.session_id IS NOT NULL AS content_deleted,
       CASE WHEN u.user_id IN {ERASED_USERS} THEN 'user' WHEN h.session_id IS NOT NULL THEN 'session' END AS deleted_by
FROM ut u LEFT JOIN hit h ON u.session_id = h.session_id""")
def jn11_session_cascade(spark, sf_dir):
    """Erased users lose what they wrote, and their sessions what was answered."""
    user = F.when(F.col("role") == "user", F.col("session_id") % 9)
    t = T.turns(spark, sf_dir).select("session_id", "turn", F.col("text").alias("content"), user.alias("user_id"))
    asked = spark.createDataFrame([(u,) for u in ERASED_USERS], "user_id long")
    return erasure.erase_cascade(t, asked).drop("user_id")


# --------------------------------------------------------------------------- JN13
SIM_K = 5


@register("jn13_similarity_search", with_views("vectors", extra=(("pe", """
SELECT label, vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM vectors, range(1, len(embedding) + 1) t(i)"""), ("c", """
SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM pe GROUP BY label, i) GROUP BY label"""),
    ("s", """
SELECT c.label AS query_id, v.vec_id,
       round(list_reduce(list_transform(range(1, len(c.q) + 1), lambda i: c.q[i] * CAST(v.embedding[i] AS DOUBLE)), lambda a, b: a + b)
             / (sqrt(list_reduce(list_transform(c.q, lambda x: x * x), lambda a, b: a + b))
                * sqrt(list_reduce(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b))), 6)
       AS similarity
FROM c, vectors v"""))) + f"""
SELECT query_id, vec_id, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
WHERE rank <= {SIM_K}""")
def jn13_similarity_search(spark, sf_dir):
    """Top-5 vectors nearest (cosine) to each label centroid."""
    v = T.vectors(spark, sf_dir)
    q = graph.centroids(v, "label").select(F.col("label").alias("query_id"), F.col("centroid").alias("query_vec"))
    return graph.similarity_top_k(v, q, SIM_K)


def every_tenth(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    return v, v.filter(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@register("jn13_similarity_lsh")
def jn13_similarity_lsh(spark, sf_dir):
    """Top-5 vectors nearest (cosine) to every tenth vector, by the hyperplane index."""
    v, q = every_tenth(spark, sf_dir)
    index = graph.HyperplaneIndex(dim=v.select(F.max(F.size("embedding"))).first()[0] or 1)
    return graph.similarity_lsh(v, q, SIM_K, index.sized(v.count()))


# --------------------------------------------------------------------------- AG13
@register("ag13_same_content_groups", with_views("texts") + """
SELECT sha256(value) AS content_hash, count(*) AS n_decisions, min(doc_id) AS first_id, max(doc_id) AS last_id
FROM texts GROUP BY 1 HAVING count(*) > 1""")
def ag13_same_content_groups(spark, sf_dir):
    return graph.same_content_groups(T.texts(spark, sf_dir), "doc_id", "value")


# --------------------------------------------------------------------------- WN3 / WN4
@register("wn3_session_order", with_views("turns") + """
SELECT session_id, turn, row_number() OVER w AS decision_seq, lag(turn) OVER w AS prev_turn
FROM turns WHERE role = 'assistant' WINDOW w AS (PARTITION BY session_id ORDER BY turn)""")
def wn3_session_order(spark, sf_dir):
    return session_decisions(spark, sf_dir).select("session_id", "turn", "decision_seq", "prev_turn")


@register("wn4_step_order", with_views("turns") + """
SELECT session_id, turn, lead(turn) OVER (PARTITION BY session_id ORDER BY turn) AS next_turn FROM turns""")
def wn4_step_order(spark, sf_dir):
    t = T.turns(spark, sf_dir).select("session_id", "turn")
    return ordering.sequence_within(t, ["session_id"], "turn", next_col="next_turn").select(
        "session_id", "turn", "next_turn")


# --------------------------------------------------------------------------- WN5
@register("wn5_event_dedupe", with_views("deliveries") + """
SELECT decision_id, event_id, min(arrived_at) AS arrived_at, bool_or(blocked) AS blocked, count(*) AS deliveries
FROM deliveries GROUP BY decision_id, event_id""")
def wn5_event_dedupe(spark, sf_dir):
    """Replayed deliveries collapse to one row per (decision_id, event_id), the first arrival."""
    return ordering.dedupe_first(T.deliveries(spark, sf_dir), ["decision_id", "event_id"], ["arrived_at"], "deliveries")


# --------------------------------------------------------------------------- WN10
TOP_K = 5


@register("wn10_top_k", with_views("records") + f"""
SELECT agent_id, decision_id, CAST(cost_usd AS DOUBLE) AS cost_usd, rank FROM (
  SELECT agent_id, decision_id, cost_usd, row_number() OVER (PARTITION BY agent_id ORDER BY cost_usd DESC, decision_id) AS rank
  FROM records) WHERE rank <= {TOP_K}""")
def wn10_top_k(spark, sf_dir):
    """Most expensive decisions per agent (exact two-level top-k)."""
    r = T.records(spark, sf_dir).select("agent_id", "decision_id", F.col("cost_usd").cast("double").alias("cost_usd"))
    return ordering.top_k(r, ["agent_id"], [F.col("cost_usd").desc(), F.col("decision_id").asc()], TOP_K,
                          "decision_id").select("agent_id", "decision_id", "cost_usd", "rank")
