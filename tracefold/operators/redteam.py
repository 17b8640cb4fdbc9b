"""Red-team verdict roll-ups (AG4-AG6, ST1, ST2, WN9, SC6).

Input is the attempts table (one row per attempt with a score or a hit
flag). Verdicts, severities and run totals are mergeable aggregates; the
requested-suite and requested-probe configs are small driver-side tables
(bounded by the run config), used in anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import constants as C
from tracefold.functions.labels import is_finding, severity_band, severity_rank


def probe_verdicts(attempts: DataFrame, keys: Sequence[str] = ("run_id", "suite", "probe"),
                   score_col: str = "score", latency_col: str = "latency_ms") -> DataFrame:
    """AG4: per probe, FAIL if any attempt is a finding else PASS, with the
    attempt count, finding count, duration and worst finding severity."""
    s = F.col(score_col)
    band = severity_band(s)
    rank = F.when(is_finding(s), severity_rank(band))
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(is_finding(s)).alias("findings"),
        F.sum(latency_col).cast("bigint").alias("duration_ms"),
        F.max(rank).alias("_worst"),
    ).select(*keys,
             F.when(F.col("findings") > 0, F.lit("fail")).otherwise(F.lit("pass")).alias("verdict"),
             "attempts", "findings", "duration_ms",
             # element_at on a literal array with a NULL index does not return
             # NULL in Spark 4.1, so the no-finding case is guarded explicitly.
             F.when(F.col("_worst").isNotNull(), F.element_at(
                 F.array(*[F.lit(x) for x in C.SEVERITIES]), (F.col("_worst") + 1).cast("int")))
             .alias("worst_severity"))


def worst_score(scores: DataFrame, key: str = "attempt_id", score_col: str = "score",
                scorer_col: str = "scorer", pos_col: str = "pos") -> DataFrame:
    """AG5: per response the highest score (0 without scores) and its scorer,
    the first scorer in order on ties."""
    order = F.struct(F.col(score_col), (-F.col(pos_col)).alias("neg_pos"))
    return scores.groupBy(key).agg(
        F.coalesce(F.max(score_col).cast("double"), F.lit(0.0)).alias("worst_score"),
        F.max_by(scorer_col, order).alias("worst_scorer"))


def run_totals(attempts: DataFrame, probes: DataFrame, run_col: str = "run_id",
               score_col: str = "score") -> DataFrame:
    """AG6: per run: probe count, fail count, duration and finding counts per severity."""
    p = probes.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("probe_count"),
        F.count_if(F.col("verdict") == "fail").alias("fail_count"),
        F.sum("duration_ms").cast("bigint").alias("duration_ms"))
    s = F.col(score_col)
    f = attempts.filter(is_finding(s)).withColumn("_sev", severity_band(s))
    sev = f.groupBy(run_col).agg(*[F.count_if(F.col("_sev") == b).alias(f"n_{b}") for b in C.SEVERITIES])
    out = p.join(sev, run_col, "left")
    return out.select(run_col, "probe_count", "fail_count", "duration_ms",
                      *[F.coalesce(F.col(f"n_{b}"), F.lit(0)).alias(f"n_{b}") for b in C.SEVERITIES])


def _config_frame(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def suite_union(probes: DataFrame, requested_suites: Sequence[str], suite_col: str = "suite") -> DataFrame:
    """ST1: every suite's probe rows plus one ERROR row per requested suite
    that produced no results."""
    spark = probes.sparkSession
    req = _config_frame(spark, [(s,) for s in dict.fromkeys(requested_suites)],
                        T.StructType([T.StructField(suite_col, T.StringType(), False)]))
    seen = probes.select(suite_col).distinct()
    missing = req.join(seen, suite_col, "left_anti")
    err = missing.select(suite_col, F.lit(C.UNKNOWN_SUITE_PROBE).alias("probe"), F.lit("error").alias("verdict"),
                         F.lit(0).cast("bigint").alias("attempts"), F.lit(0).cast("bigint").alias("findings"))
    return probes.select(suite_col, "probe", "verdict", F.col("attempts").cast("bigint"),
                         F.col("findings").cast("bigint")).unionByName(err)


def missing_probes(probes: DataFrame, requested: Sequence[tuple[str, str]]) -> DataFrame:
    """ST2: an ERROR row (0 attempts, one info finding) per requested
    (suite, probe) that has no result, as when its harness was unavailable."""
    spark = probes.sparkSession
    req = _config_frame(spark, list(dict.fromkeys(requested)), T.StructType([
        T.StructField("suite", T.StringType(), False), T.StructField("probe", T.StringType(), False)]))
    seen = probes.select("suite", "probe").distinct()
    return req.join(seen, ["suite", "probe"], "left_anti").select(
        "suite", "probe", F.lit("error").alias("verdict"), F.lit(0).cast("bigint").alias("attempts"),
        F.lit("info").alias("finding_severity"))


def probe_recurrence(attempts: DataFrame, hash_col: str = "prompt_hash", run_col: str = "run_id") -> DataFrame:
    """WN9: correlate identical probe bodies across runs: the first run that
    sent the body, how many runs sent it, and whether this row repeats it.

    Aggregated per hash (partial, distinct on (hash, run) first), then joined
    back; a hash repeated in a third of all rows is split by AQE's skew join.
    """
    per = attempts.groupBy(hash_col).agg(
        F.min(run_col).alias("first_run_id"), F.count_distinct(run_col).alias("n_runs"),
        F.count(F.lit(1)).alias("n_attempts"))
    j = attempts.join(per, hash_col)
    return j.withColumn("is_recurrence", F.col(run_col) != F.col("first_run_id"))


def emit_rows(runs: DataFrame, probes: DataFrame, run_col: str = "run_id") -> DataFrame:
    """SC6: one parent row per run and one child row per probe, in one table.

    Rows carry the runner's own class names and, explicitly, the allowlist
    class they map to (``red_team_result``).
    """
    r = runs.select(F.lit("redteam_run").alias("row_class"), run_col, F.lit(None).cast("string").alias("suite"),
                    F.lit(None).cast("string").alias("probe"), F.lit(None).cast("string").alias("verdict"),
                    F.col("probe_count").cast("bigint").alias("count_a"),
                    F.col("fail_count").cast("bigint").alias("count_b"),
                    F.col("duration_ms").cast("bigint").alias("duration_ms"))
    p = probes.select(F.lit("redteam_probe").alias("row_class"), run_col, "suite", "probe", "verdict",
                      F.col("attempts").cast("bigint").alias("count_a"),
                      F.col("findings").cast("bigint").alias("count_b"),
                      F.col("duration_ms").cast("bigint").alias("duration_ms"))
    return r.unionByName(p).withColumn("allowlist_class", F.lit("red_team_result"))
