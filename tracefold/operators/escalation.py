"""Escalation service as batch jobs: review matching, verdict idempotency,
deadline fallback, alerts and gauges (JN9, JN10, AG11, AG12, AG14, WN6,
SM4, SM7, SM8 batch twins).

Verdict handling is keyed by escalation; every per-escalation step is an
aggregate (``min_by`` for "first verdict wins") followed by a join of one
row per escalation, so a flood of deliveries for one escalation combines
map-side instead of sorting in one task. Joins from deliveries to their
escalation go through ``join_split``, which splits such a flood into parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions.hashing import hmac_sha256_hex
from tracefold.functions.pii import DEFAULT_ANALYZER, PatternAnalyzer
from tracefold.operators.graph import Part, decision_documents
from tracefold.operators.ordering import join_split


def normalize_verdict(v):
    expr = v
    for alias, canon in C.REVIEW_VERDICT_ALIASES.items():
        expr = F.when(v == alias, F.lit(canon)).otherwise(expr)
    return expr


def _judged(reviews: DataFrame, escalations: DataFrame, stale_days: int) -> DataFrame:
    """Reviews with ``__reason``: why a verdict can't count whatever else was delivered, null if it can."""
    e = escalations.select("escalation_id", "requested_at", "deadline", "fallback", "required_rank")
    j = join_split(reviews, e, ["escalation_id"])
    stale = F.col("received_at") > F.col("reviewed_at") + F.make_dt_interval(days=F.lit(stale_days))
    timed_out = (F.col("fallback") != "defer") & (F.col("reviewed_at") > F.col("deadline"))
    reason = (F.when(F.col("requested_at").isNull(), F.lit("no_open_escalation"))
               .when(F.col("reviewer_rank") < F.col("required_rank"), F.lit("role_too_low"))
               .when(stale, F.lit("stale"))
               .when(timed_out, F.lit("no_open_escalation")))
    return j.withColumn("verdict", normalize_verdict(F.col("verdict"))).withColumn("__reason", reason)


def qualified_reviews(reviews: DataFrame, escalations: DataFrame, stale_days: int = C.STALE_VERDICT_DAYS) -> DataFrame:
    """The verdicts that may answer their escalation: it exists, the reviewer's rank suffices, the verdict was not
    stale when it came in, and no fallback had closed the escalation. SM7, SM8, WN6 and AG14 start from these."""
    return _judged(reviews, escalations, stale_days).filter(F.col("__reason").isNull()).select(*reviews.columns)


def match_reviews(reviews: DataFrame, escalations: DataFrame, stale_days: int = C.STALE_VERDICT_DAYS) -> DataFrame:
    """JN9: attach each verdict to its escalation and decide acceptance.

    A verdict is stale if it was more than ``stale_days`` old when received. The first qualified verdict (by time,
    then nonce) is accepted and closes the escalation; those after it find no open escalation. Replays of the
    accepted nonce have its outcome.
    """
    j = _judged(reviews, escalations, stale_days)
    o = F.struct("reviewed_at", "nonce")
    first = j.filter(F.col("__reason").isNull()).groupBy("escalation_id").agg(F.min(o).alias("__first"))
    j = join_split(j, first, ["escalation_id"])
    outcome = F.coalesce("__reason", F.when(o == F.col("__first"), F.lit("accepted")).otherwise(F.lit("no_open_escalation")))
    return j.withColumn("outcome", outcome).drop("__reason", "__first")


def first_verdicts(reviews: DataFrame) -> DataFrame:
    """Per escalation, the earliest verdict (ties by nonce), and delivery counts."""
    o = F.struct("reviewed_at", "nonce")
    return reviews.groupBy("escalation_id").agg(
        F.min_by("verdict", o).alias("first_verdict"), F.min_by("nonce", o).alias("first_nonce"),
        F.min("reviewed_at").alias("first_reviewed_at"), F.count(F.lit(1)).alias("deliveries"))


def conflicting_verdicts(reviews: DataFrame) -> DataFrame:
    """WN6: first verdict per escalation wins; later different verdicts are
    conflicts (rejected and alerted). Deliveries are first counted per
    escalation and verdict, so a flood for one escalation combines map-side."""
    o = F.struct("reviewed_at", "nonce")
    per = reviews.groupBy("escalation_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min(o).alias("o"))
    per = per.groupBy("escalation_id").agg(F.min_by("verdict", "o").alias("first_verdict"),
                                           (F.sum("n") - F.min_by("n", "o")).alias("n_conflicting"))
    return per.withColumn("alert", F.col("n_conflicting") > 0)


def verdict_idempotency(reviews: DataFrame) -> DataFrame:
    """SM8 batch twin: one row per delivered nonce: ``accepted`` (the first
    verdict), ``duplicate`` (same verdict again, replays folded into
    ``deliveries``) or ``conflict`` (a different verdict)."""
    per_nonce = reviews.groupBy("escalation_id", "nonce", "verdict").agg(
        F.min("reviewed_at").alias("reviewed_at"), F.count(F.lit(1)).alias("deliveries"))
    f = first_verdicts(per_nonce)
    j = join_split(per_nonce, f.select("escalation_id", "first_verdict", "first_nonce"), ["escalation_id"], "inner")
    outcome = (F.when(F.col("nonce") == F.col("first_nonce"), F.lit("accepted"))
                .when(F.col("verdict") == F.col("first_verdict"), F.lit("duplicate"))
                .otherwise(F.lit("conflict")))
    return j.select("escalation_id", "nonce", "verdict", "deliveries", outcome.alias("outcome"))


PACKET_SCHEMA_VERSION = "1.0"


def review_packets(escalations: DataFrame, decisions: DataFrame, scores: DataFrame, parts: Mapping[str, Part], key: bytes | str,
                   questions: Mapping[str, Sequence[str]], profile: str = C.DEFAULT_PROFILE,
                   analyzer: PatternAnalyzer = DEFAULT_ANALYZER) -> DataFrame:
    """JN10: the whole review packet of each escalation, one row.

    ``decisions`` has ``decision_id, ts, input, output, user_id, session_id, session_turn_number``. Both texts carry
    placeholders for PII, user and session travel as keyed hashes (null stays null). The triggering rubric is that of
    the lowest score (ties: the first by name) and brings its ``questions``; without a score it is null and there are
    none. ``all_judge_scores`` has the lowest score per rubric. ``parts`` (retrievals, steps, guardrail events, ...) become
    ordered arrays. Only rows of escalated decisions are folded, each part on its own; an escalation whose decision is
    gone keeps its row with nulls.
    """
    ids = escalations.select("decision_id").filter(F.col("decision_id").isNotNull()).distinct()

    def wanted(df: DataFrame, name: str = "decision_id") -> DataFrame:
        return df.join(ids.withColumnRenamed("decision_id", name), name, "left_semi")

    per = wanted(scores).groupBy("decision_id", "rubric").agg(F.min("score").alias("score"))
    judged = per.groupBy("decision_id").agg(F.min(F.struct("score", "rubric")).alias("__low"),
                                            F.array_sort(F.collect_list(F.struct("rubric", "score"))).alias("all_judge_scores"))
    docs = decision_documents(wanted(decisions), {n: replace(p, rows=wanted(p.rows, p.key)) for n, p in parts.items()})
    asked = F.array().cast("array<string>")
    for rubric, qs in questions.items():
        asked = F.when(F.col("__low.rubric") == rubric, F.array(*[F.lit(q) for q in qs]).cast("array<string>")).otherwise(asked)
    hours = F.floor((F.unix_seconds(F.col("deadline").cast("timestamp")) - F.unix_seconds(F.col("requested_at").cast("timestamp"))) / 3600)
    j = escalations.select("escalation_id", "decision_id", "tenant_id", "agent_id", "requested_at", "deadline").join(
        docs, "decision_id", "left").join(judged, "decision_id", "left")
    return j.select(
        "escalation_id", "tenant_id", "agent_id", F.lit(profile).alias("regulatory_profile"), "decision_id", F.col("ts").alias("decision_timestamp"),
        analyzer.placeholders(F.col("input")).alias("input_redacted"), analyzer.placeholders(F.col("output")).alias("output_redacted"),
        *parts, F.col("__low.rubric").alias("triggering_rubric_id"), F.col("__low.score").alias("triggering_score"), "all_judge_scores",
        hmac_sha256_hex(F.col("user_id").cast("string"), key).alias("user_id_hash"),
        hmac_sha256_hex(F.col("session_id").cast("string"), key).alias("session_id_hash"), "session_turn_number",
        asked.alias("review_questions"), F.concat(hours.cast("string"), F.lit("h")).alias("expected_response_time"),
        F.lit(PACKET_SCHEMA_VERSION).alias("schema_version"))


def nonce_replays(deliveries: DataFrame, window_hours: int = 24, ts_col: str = "reviewed_at",
                  bucket_hours: int = 1) -> DataFrame:
    """SM4 batch twin: reject a delivery whose nonce was seen in the previous
    ``window_hours``.

    The previous delivery of each nonce comes from the bucketed
    ``sequence_within`` (time buckets of ``bucket_hours``), so a replay flood
    of one nonce is ranked bucket by bucket, never in one task.
    """
    from tracefold.operators.ordering import sequence_within
    d = deliveries.select("nonce", F.unix_micros(F.col(ts_col).cast("timestamp")).alias("__us"))
    seq = sequence_within(d, ["nonce"], "__us", bucket_width=bucket_hours * 3_600_000_000,
                          rank_col="__seq", prev_col="__prev", next_col="__next")
    rejected = F.col("__prev").isNotNull() & (F.col("__us") - F.col("__prev") <= window_hours * 3_600_000_000)
    return seq.groupBy("nonce").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(rejected).alias("rejected"))


def deadline_fallback(escalations: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """SM7 batch twin: escalations past their deadline with no verdict by
    then get the profile fallback: fail-closed -> reject, fail-open ->
    approve, defer -> stays open. Fallbacks carry the timeout reviewer."""
    t = F.lit(as_of).cast("timestamp_ntz")
    first = reviews.groupBy("escalation_id").agg(F.min("reviewed_at").alias("__first"))
    overdue = (escalations.filter(F.col("deadline") < t).join(first, "escalation_id", "left")
                          .filter(F.col("__first").isNull() | (F.col("__first") > F.col("deadline"))))
    verdict = (F.when(F.col("fallback") == "fail-closed", F.lit("reject"))
                .when(F.col("fallback") == "fail-open", F.lit("approve")))
    return overdue.select("escalation_id", "fallback", verdict.alias("verdict"),
                          F.lit(C.TIMEOUT_REVIEWER).alias("reviewer_id"),
                          F.when(verdict.isNull(), F.lit("open")).otherwise(F.lit("closed")).alias("status"))


def escalation_rate(decisions: DataFrame, key: str = "agent_id", flag_col: str = "escalated",
                    alert_share: float = C.ESCALATION_ALERT_SHARE) -> DataFrame:
    """AG11: share of decisions escalated per agent; alert above ``alert_share``."""
    g = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("n_decisions"),
                                   F.count_if(F.col(flag_col)).alias("n_escalated"))
    share = F.col("n_escalated") / F.col("n_decisions")
    return g.withColumn("share", share).withColumn("alert", share > F.lit(alert_share))


def fetch_abuse(fetches: DataFrame, window: str, threshold: int, reviewer_col: str = "reviewer_id",
                ts_col: str = "ts") -> DataFrame:
    """AG12: reviewers fetching content more than ``threshold`` times per window."""
    g = fetches.groupBy(reviewer_col, F.window(ts_col, window).alias("w")).agg(F.count(F.lit(1)).alias("n_fetches"))
    return g.filter(F.col("n_fetches") > threshold).select(
        reviewer_col, F.col("w.start").alias("window_start"), "n_fetches")


def pending_gauge(escalations: DataFrame, reviews: DataFrame, as_of: str, key: str = "tenant_id") -> DataFrame:
    """AG14: escalations open at ``as_of`` (requested, no verdict yet), per tenant."""
    t = F.lit(as_of).cast("timestamp_ntz")
    done = reviews.filter(F.col("reviewed_at") <= t).select("escalation_id").distinct()
    open_ = escalations.filter(F.col("requested_at") <= t).join(done, "escalation_id", "left_anti")
    return open_.groupBy(key).agg(F.count(F.lit(1)).alias("open_escalations"))
