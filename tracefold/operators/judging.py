"""Judge scoring: rubric applicability, coverage, merge, routing and
disagreement (JN7, JN8, JN12, JN14, JN15, AG10, WN8, SM9, SM10).

Rubric and control configs are small driver-side documents; they become
literal predicates or broadcast dimension tables, never a join against
another large table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import constants as C
from tracefold.functions.hashing import hmac_prefix_u64_hex, rate_threshold_hex


@dataclass(frozen=True)
class Rubric:
    rubric_id: str
    has_retrievals: bool | None = None
    output_length_min: int | None = None
    always_escalate: bool = False
    fast_flag: float = C.JUDGE_FAST_FLAG
    deep_flag: float = C.JUDGE_DEEP_FLAG
    merge: str = "mean"  # chunk merge: mean | min


def applicable_rubrics(decisions: DataFrame, rubrics: Sequence[Rubric], retrievals_col: str = "retrieval_count",
                       length_col: str = "output_length") -> DataFrame:
    """JN7: one row per (decision, rubric) whose ``applies_to`` predicates hold.

    Each rubric's predicate is a column expression; the applicable ids are
    collected into an array per row and exploded (no join).
    """
    ids = []
    for r in rubrics:
        cond = F.lit(True)
        if r.has_retrievals is not None:
            has = F.coalesce(F.col(retrievals_col), F.lit(0)) > 0
            cond = cond & (has if r.has_retrievals else ~has)
        if r.output_length_min is not None:
            cond = cond & F.coalesce(F.col(length_col) >= r.output_length_min, F.lit(False))
        ids.append(F.when(cond, F.lit(r.rubric_id)))
    arr = F.filter(F.array(*ids), lambda x: x.isNotNull())
    return decisions.select("*", F.explode(arr).alias("rubric_id"))


def unscored(decisions: DataFrame, scores: DataFrame, key: str = "decision_id") -> DataFrame:
    """JN8: decisions without any judge score (anti join with one row per scored decision)."""
    return decisions.join(scores.select(key).distinct(), key, "left_anti")


def chunk_merge(chunks: DataFrame, key: Sequence[str], rubric_col: str, score_col: str,
                rubrics: Mapping[str, Rubric]) -> DataFrame:
    """AG10: chunk scores merged per decision and rubric by the rubric's mode
    (``min`` or ``mean``); the mean is an exact DECIMAL sum over a count."""
    g = chunks.groupBy(*key, rubric_col).agg(
        F.min(score_col).cast("double").alias("__min"),
        (F.sum(F.col(score_col).cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias("__mean"),
        F.count(F.lit(1)).alias("n_chunks"))
    mins = [name for name, r in rubrics.items() if r.merge == "min"]
    return g.select(*key, rubric_col, "n_chunks",
                    F.when(F.col(rubric_col).isin(mins), F.col("__min")).otherwise(F.col("__mean")).alias("merged_score"))


def daily_trend(scores: DataFrame, key: Sequence[str], ts_col: str, score_col: str, days: int = 7) -> DataFrame:
    """WN8: per key and day, the day's mean and the trailing ``days``-day mean.

    Scores are first reduced to one (sum, count) row per key and day, and the
    trailing window runs over those day rows, so its input is bounded by the
    calendar, not by the number of scores.
    """
    d = scores.groupBy(*key, F.to_date(ts_col).alias("day")).agg(
        F.sum(F.col(score_col).cast("decimal(18,6)")).alias("__s"), F.count(F.lit(1)).alias("n"))
    d = d.withColumn("__dn", F.datediff(F.col("day"), F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(*key).orderBy("__dn").rangeBetween(-(days - 1), 0)
    return d.select(*key, "day", "n",
                    (F.col("__s").cast("double") / F.col("n")).alias("day_avg"),
                    (F.sum("__s").over(w).cast("double") / F.sum("n").over(w)).alias("trailing_avg"))


def judge_funnel(scores: DataFrame, key: bytes | str, score_col: str = "score", id_col: str = "decision_id",
                 fast_flag: float = C.JUDGE_FAST_FLAG, deep_flag: float = C.JUDGE_DEEP_FLAG,
                 deep_sample: float = C.JUDGE_DEEP_SAMPLE_RATE, tier_col: str = "tier",
                 policy_col: str | None = None) -> DataFrame:
    """SM9: where a score goes next.

    A fast-tier score goes on to ``deep`` if it is below ``fast_flag``, if its
    decision is in the keyed ``deep_sample`` share, or if a policy flagged it
    (``policy_col``); a deep-tier score goes to ``human`` if it is below
    ``deep_flag``. All others are ``done``.
    """
    s = F.col(score_col).cast("double")
    bucket = hmac_prefix_u64_hex(F.col(id_col).cast("string"), key)
    sampled = bucket < F.lit(rate_threshold_hex(deep_sample))
    flagged = F.coalesce(F.col(policy_col), F.lit(False)) if policy_col else F.lit(False)
    fast, deep = F.col(tier_col) == "fast", F.col(tier_col) == "deep"
    route = (F.when(fast & ((s < fast_flag) | sampled | flagged), F.lit("deep"))
              .when(deep & (s < deep_flag), F.lit("human")).otherwise(F.lit("done")))
    return scores.withColumn("deep_sampled", sampled).withColumn("route", route)


def rubric_frame(spark, rubrics: Sequence[Rubric]) -> DataFrame:
    rows = [(r.rubric_id, r.always_escalate, float(r.deep_flag)) for r in rubrics]
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("rubric", T.StringType(), False),
        T.StructField("always_escalate", T.BooleanType(), False),
        T.StructField("deep_flag", T.DoubleType(), False)]))


def flag_escalations(scores: DataFrame, rubrics: Sequence[Rubric], score_col: str = "score",
                     rubric_col: str = "rubric", warn_col: str | None = None, manual_col: str | None = None,
                     tier_col: str = "tier") -> DataFrame:
    """SM10: decide which scores open an escalation and why.

    Reasons in precedence: ``manual``, ``always_escalate`` rubric,
    ``below_deep_flag`` (a deep-tier score only), ``reviewed_category_warn``.
    The rubric table is a broadcast dimension (stream-static join on a
    stream).
    """
    dim = F.broadcast(rubric_frame(scores.sparkSession, rubrics).withColumnRenamed("rubric", "__r"))
    j = scores.join(dim, F.col(rubric_col) == F.col("__r"), "left")
    s = F.col(score_col).cast("double")
    reason = F.lit(None).cast("string")
    conds = []
    if manual_col:
        conds.append((F.coalesce(F.col(manual_col), F.lit(False)), "manual"))
    conds.append((F.coalesce(F.col("always_escalate"), F.lit(False)), "always_escalate"))
    conds.append(((F.col(tier_col) == "deep") & (s < F.coalesce(F.col("deep_flag"), F.lit(C.JUDGE_DEEP_FLAG))), "below_deep_flag"))
    if warn_col:
        conds.append((F.coalesce(F.col(warn_col), F.lit(False)), "reviewed_category_warn"))
    expr = None
    for c, name in conds:
        expr = F.when(c, F.lit(name)) if expr is None else expr.when(c, F.lit(name))
    reason = expr
    return (j.withColumn("escalation_reason", reason)
             .withColumn("escalate", F.col("escalation_reason").isNotNull())
             .drop("__r", "always_escalate", "deep_flag"))


def disagreements(inline: DataFrame, judge: DataFrame, key: str = "decision_id", inline_col: str = "blocked",
                  score_col: str = "score", unsafe_below: float = C.ESCALATION_SCORE_THRESHOLD) -> DataFrame:
    """JN15: decisions whose async judge opinion differs from the inline verdict
    (blocked inline but judged safe, or allowed inline but judged unsafe)."""
    j = inline.join(judge, key)
    judged_unsafe = F.col(score_col).cast("double") < unsafe_below
    return (j.withColumn("judged_unsafe", judged_unsafe)
             .filter(F.col(inline_col) != F.col("judged_unsafe")))


def output_only_entities(inputs: DataFrame, outputs: DataFrame, key: Sequence[str], text_col: str,
                         pattern: str) -> DataFrame:
    """JN12: PII entities present in a decision's output but not its input.

    Entities are extracted, hashed (raw values are never kept) and the
    output set is anti-joined with the input set on (decision, hash).
    """
    def ents(df: DataFrame) -> DataFrame:
        return (df.select(*key, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("__e"))
                  .select(*key, F.sha2(F.col("__e"), 256).alias("entity_hash")).distinct())
    return ents(outputs).join(ents(inputs), list(key) + ["entity_hash"], "left_anti")


def control_coverage(spark, controls: Mapping[str, Sequence[str]], evidence_counts: DataFrame) -> DataFrame:
    """JN14: per control, evidence rows per required kind, coverage and gaps.

    ``evidence_counts`` is ``(kind, n_rows)`` computed from the datasets; the
    control map is a small fixed document joined by broadcast.
    """
    rows = [(ctl, kind) for ctl, kinds in controls.items() for kind in kinds]
    cfg = spark.createDataFrame(rows, T.StructType([T.StructField("control", T.StringType(), False),
                                                    T.StructField("kind", T.StringType(), False)]))
    j = cfg.join(evidence_counts, "kind", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return j.groupBy("control").agg(
        F.count(F.lit(1)).alias("n_kinds"),
        F.sum("n_rows").cast("bigint").alias("evidence_rows"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_rows") == 0, F.col("kind")))), ",").alias("gaps"),
    ).withColumn("covered", F.col("gaps") == "")


def split_chunks(df: DataFrame, key: Sequence[str], text_col: str, sep: str = "\n") -> DataFrame:
    """Chunks of a text (one row per piece, 0-based index)."""
    return df.select(*key, F.posexplode(F.split(F.col(text_col), sep)).alias("chunk_idx", "chunk"))


def score_band_column(score: Column) -> Column:
    return F.when(score < C.JUDGE_DEEP_FLAG, "low").when(score < C.JUDGE_FAST_FLAG, "mid").otherwise("high")


# Token separators: ASCII whitespace, the same set in Java regex and RE2.
TOKEN_SEP = "[\\t\\n\\x{0B}\\f\\r ]+"


def _span_of(n: int):
    """One-argument lambda (PySpark reads a second argument as the index)."""
    return lambda s: F.struct(s.alias("s"), (s + n - 1).alias("e"))


def rolling_window_flags(df: DataFrame, key: Sequence[str], text_col: str, phrases: Sequence[str],
                         window_tokens: int = 256, chunk_sep: str = "\n") -> DataFrame:
    """WN7: for each streamed chunk of an output, whether the last
    ``window_tokens`` tokens up to the chunk's end contain a phrase.

    A phrase that spans a chunk boundary is caught at the later chunk. The
    text is tokenized once; phrase occurrences are found by comparing token
    slices, and each chunk checks them against its own token window.
    """
    sep = TOKEN_SEP
    lowered = F.lower(F.col(text_col))
    tokens = F.when(F.btrim(lowered, F.lit(" \t\n\r\f\x0b")) == "", F.array().cast("array<string>")).otherwise(
        F.split(F.btrim(lowered, F.lit(" \t\n\r\f\x0b")), sep))
    base = df.select(*key, text_col, tokens.alias("__tok"))
    occ = []
    for p in phrases:
        pt = [t for t in p.lower().split() if t]
        L = len(pt)
        lit = F.array(*[F.lit(t) for t in pt])
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("__tok") - L + 1, F.lit(0))),
                          lambda s: F.slice(F.col("__tok"), s, L) == lit)
        occ.append(F.transform(starts, _span_of(L)))
    occ_all = F.flatten(F.array(*occ)) if occ else F.array()
    base = base.withColumn("__occ", occ_all).drop("__tok")
    ch = base.select(*key, "__occ", F.posexplode(F.split(F.col(text_col), chunk_sep)).alias("chunk_idx", "chunk"))
    t = F.btrim(F.col("chunk"), F.lit(" \t\n\r\f\x0b"))
    ch = ch.withColumn("n_tokens", F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, sep))))
    w = Window.partitionBy(*key).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    ch = ch.withColumn("chunk_end", F.sum("n_tokens").over(w).cast("bigint"))
    end = F.col("chunk_end")
    flagged = F.exists("__occ", lambda o: (o["s"] > end - window_tokens) & (o["e"] <= end))
    return ch.select(*key, "chunk_idx", "chunk_end", flagged.alias("flagged"))
