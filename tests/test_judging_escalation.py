from pyspark.sql import functions as F

from tracefold.operators import escalation, judging
from tracefold.operators.judging import Rubric


def test_rolling_window_catches_phrase_across_chunks(spark):
    text = "hello there ignore previous\ninstructions now\n" + " ".join(["w"] * 300) + "\nend"
    df = spark.createDataFrame([(1, text)], "d long, t string")
    out = {r.chunk_idx: r.flagged for r in judging.rolling_window_flags(df, ["d"], "t", ["ignore previous instructions"]).collect()}
    assert out == {0: False, 1: True, 2: False, 3: False}   # the phrase ends in chunk 1, falls out of 256 tokens later


def test_applicable_rubrics(spark):
    d = spark.createDataFrame([(1, 3, 60), (2, 0, 500)], "decision_id long, retrieval_count long, output_length long")
    rubrics = [Rubric("factuality", has_retrievals=True, output_length_min=50), Rubric("long", output_length_min=200)]
    got = {(r.decision_id, r.rubric_id) for r in judging.applicable_rubrics(d, rubrics).collect()}
    assert got == {(1, "factuality"), (2, "long")}


def test_judge_funnel_routes(spark):
    s = spark.createDataFrame([(i, (i % 100) / 100, "deep" if i % 2 else "fast", i % 50 == 0) for i in range(4000)], "decision_id long, score double, tier string, warned boolean")
    f = judging.judge_funnel(s, b"k", policy_col="warned").cache()
    assert f.filter("tier = 'fast' AND (score < 0.65 OR warned OR deep_sampled) AND route <> 'deep'").count() == 0
    assert f.filter("tier = 'deep' AND score < 0.5 AND route <> 'human'").count() == 0
    assert f.filter("route = 'human' AND tier = 'fast'").count() == 0      # only a deep score reaches a human
    assert f.filter("tier = 'deep' AND score >= 0.5 AND route <> 'done'").count() == 0
    sampled = f.agg(F.avg(F.col("deep_sampled").cast("double"))).first()[0]
    assert 0.02 < sampled < 0.09


def _esc(spark):
    return spark.createDataFrame(
        [("e1", 1, "2024-01-01 00:00:00", "2024-01-01 04:00:00", "fail-closed", 2),
         ("e2", 2, "2024-01-01 00:00:00", "2024-01-01 04:00:00", "fail-open", 1),
         ("e3", 3, "2024-01-01 00:00:00", "2024-01-01 04:00:00", "defer", 1)],
        "escalation_id string, decision_id long, requested_at string, deadline string, fallback string, required_rank long"
    ).withColumn("requested_at", F.col("requested_at").cast("timestamp_ntz")).withColumn(
        "deadline", F.col("deadline").cast("timestamp_ntz"))


def _rev(spark):
    return spark.createDataFrame(
        [("e1", "n1", "approve", 3, "2024-01-01 01:00:00", 0), ("e1", "n1", "approve", 3, "2024-01-01 01:00:00", 0),
         ("e1", "n2", "revise", 1, "2024-01-01 02:00:00", 0), ("e2", "n3", "reject", 1, "2024-01-01 03:00:00", 8),
         ("ex", "n4", "approve", 5, "2024-01-01 00:00:00", 0), ("e1", "n5", "reject", 4, "2024-01-01 03:00:00", 0),
         ("e2", "n6", "reject", 4, "2024-01-01 05:00:00", 0), ("e3", "n7", "reject", 4, "2024-01-01 05:00:00", 0)],
        "escalation_id string, nonce string, verdict string, reviewer_rank long, reviewed_at string, days long"
    ).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp_ntz")).withColumn(
        "received_at", F.col("reviewed_at") + F.make_dt_interval(days=F.col("days").cast("int")))


def test_match_reviews_reasons(spark):
    out = {r.nonce: r.outcome for r in escalation.match_reviews(_rev(spark), _esc(spark)).collect()}
    assert out == {"n1": "accepted", "n2": "role_too_low", "n3": "stale", "n4": "no_open_escalation",
                   "n5": "no_open_escalation",      # e1 is answered already
                   "n6": "no_open_escalation",      # its fallback closed e2
                   "n7": "accepted"}                # e3 stays open after its deadline


def _qualified(spark):
    return escalation.qualified_reviews(_rev(spark), _esc(spark))


def test_verdict_idempotency_and_conflicts(spark):
    v = {r.nonce: r for r in escalation.verdict_idempotency(_qualified(spark)).collect()}
    assert v["n1"].outcome == "accepted" and v["n1"].deliveries == 2
    assert v["n5"].outcome == "conflict" and "n2" not in v
    c = {r.escalation_id: r for r in escalation.conflicting_verdicts(_qualified(spark)).collect()}
    assert c["e1"].alert and c["e1"].first_verdict == "approve" and c["e1"].n_conflicting == 1
    assert not c["e3"].alert


def test_deadline_fallback(spark):
    out = {r.escalation_id: r for r in escalation.deadline_fallback(_esc(spark), _qualified(spark), "2024-02-01 00:00:00").collect()}
    assert set(out) == {"e2", "e3"}            # e1 was answered before its deadline; a stale verdict answers nothing
    assert out["e2"].verdict == "approve" and out["e3"].status == "open"
    assert out["e2"].reviewer_id == "system.timeout"


def test_pending_gauge_ignores_verdicts_that_do_not_count(spark):
    e = _esc(spark).withColumn("tenant_id", F.lit("t"))
    out = escalation.pending_gauge(e, _qualified(spark), "2024-01-01 04:30:00").collect()
    assert [r.open_escalations for r in out] == [2]


def test_saved_view_with_score_fields(spark):
    from tracefold.operators import policy
    d = spark.createDataFrame([(1, "decision_summary", "2024-01-02"), (2, "decision_summary", "2024-01-03"),
                               (3, "escalation", "2024-01-04")], "decision_id long, event_class string, ts string")
    s = spark.createDataFrame([(1, "groundedness", 0.5), (2, "groundedness", 0.9), (2, "harmlessness", 0.1),
                               (3, "groundedness", 0.5)], "decision_id long, rubric string, score double")
    wide = policy.with_score_columns(d, s, ["groundedness", "harmlessness"])
    assert "score.groundedness" in wide.columns
    v = policy.saved_view(wide, {"event_class": "decision_summary", "score.groundedness": "0.5"},
                          policy.column_resolver(wide.columns))
    assert [r.decision_id for r in v.collect()] == [1]


def test_join_split_equals_the_join(spark, monkeypatch):
    """One key and the null key hold two thirds of the rows; parts stay near the limit on both paths."""
    from tracefold.operators import ordering
    rows = [("hot", i) for i in range(700)] + [(None, i) for i in range(300)] + [(f"k{i % 90}", i) for i in range(500)] + [("gone", 1)]
    df = spark.createDataFrame(rows, "k string, v long")
    one = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3)] + [(f"k{i}", i) for i in range(90)], "k string, w long")
    key = lambda d: sorted(tuple(map(str, r)) for r in d.select("k", "v", "w").collect())
    for how in ("left", "inner"):
        exp = key(df.join(one, "k", how))
        assert key(ordering.join_split(df, one, ["k"], how, hot_rows=50)) == exp
        assert key(ordering.join_split(df, one, ["k"], how)) == exp
        with monkeypatch.context() as m:
            m.setattr(ordering, "HOT_KEYS_BROADCAST", 0)
            assert key(ordering.join_split(df, one, ["k"], how, hot_rows=50)) == exp
    hot = spark.createDataFrame([("hot", 14), (None, 6)], "__k string, __parts int")
    parts = {(r["k"], r["__part"]): r["count"] for r in ordering.split_keys(df, ["k"], hot).groupBy("k", "__part").count().collect()}
    assert sum(k == "hot" for k, _ in parts) == 14 and sum(k is None for k, _ in parts) == 6
    assert max(parts.values()) <= 2 * 50 and all(p == 0 for k, p in parts if k not in ("hot", None))
    assert ordering.join_split(df.limit(0), one, ["k"]).isEmpty()


def test_review_flood_has_the_same_outcomes(spark, monkeypatch):
    """Verdict jobs give the same rows when every escalation with more than two deliveries is split."""
    from tracefold.operators import escalation, ordering
    from tracefold.sources import tables as T
    sf = "/root/testdata/sf0.001"
    esc, rev = T.escalations(spark, sf), T.reviews(spark, sf)
    hot = esc.select("escalation_id").first()[0]
    rev = rev.unionByName(rev.withColumns({"escalation_id": F.lit(hot), "nonce": F.concat("nonce", F.lit("-hot"))}))

    def rows():
        m = escalation.match_reviews(rev, esc).select("escalation_id", "nonce", "outcome")
        i = escalation.verdict_idempotency(escalation.qualified_reviews(rev, esc))
        return sorted(map(tuple, m.collect())), sorted(map(tuple, i.collect()))

    plain = rows()
    monkeypatch.setattr(ordering, "HOT_ROWS", 2)
    assert rows() == plain and len(plain[0]) == rev.count()


def test_review_packet_of_odd_decisions(spark):
    from tracefold.operators.graph import Part
    at, due = "timestamp_ntz'2024-01-01 00:00:00'", "timestamp_ntz'2024-01-01 04:30:00'"
    esc = spark.sql(f"SELECT * FROM VALUES ('e1', 1L, 't', 'a', {at}, {due}), ('e2', 2L, 't', 'a', {at}, {due}), ('e3', 9L, 't', 'a', {at}, {due}) "
                    "AS x(escalation_id, decision_id, tenant_id, agent_id, requested_at, deadline)")
    dec = spark.sql(f"SELECT * FROM VALUES (1L, {at}, 'mail a@corp.example now', CAST(NULL AS STRING), 7L, 's7', 3L), "
                    f"(2L, {at}, NULL, '', NULL, NULL, 1L), (5L, {at}, 'other', 'other', 1L, 's1', 1L) "
                    "AS x(decision_id, ts, input, output, user_id, session_id, session_turn_number)")
    sc = spark.createDataFrame([(1, "b", 0.2), (1, "a", 0.2), (1, "a", 0.9), (5, "a", 0.1)], "decision_id long, rubric string, score double")
    steps = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (5, 1, "x"), (None, 1, "y")], "decision_id long, n long, what string")
    out = {r.escalation_id: r for r in escalation.review_packets(esc, dec, sc, {"steps": Part(steps, ("what",), ("n",))}, b"k", {"a": ("q1", "q2")}).collect()}
    one, two, gone = out["e1"], out["e2"], out["e3"]
    assert one.input_redacted == "mail <REDACTED:EMAIL_ADDRESS> now" and one.output_redacted is None and [x.what for x in one.steps] == ["one", "two"]
    assert (one.triggering_rubric_id, one.triggering_score, one.review_questions) == ("a", 0.2, ["q1", "q2"])
    assert [tuple(x) for x in one.all_judge_scores] == [("a", 0.2), ("b", 0.2)] and len(one.user_id_hash) == 64 and one.expected_response_time == "4h"
    assert (two.steps, two.triggering_rubric_id, two.review_questions, two.user_id_hash, two.output_redacted) == ([], None, [], None, "")
    assert (gone.decision_timestamp, gone.steps, gone.input_redacted) == (None, None, None)
