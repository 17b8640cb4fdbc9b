import pytest
from pyspark.sql import functions as F

from tracefold.functions.labels import decision_status, severity_band
from tracefold.operators import redteam


@pytest.mark.parametrize("score,band", [(0.95, "critical"), (0.80, "high"), (0.55, "medium"), (0.30, "low"),
                                        (0.10, "info"), (0.9, "critical"), (0.75, "high"), (0.5, "medium")])
def test_severity_bands(spark, score, band):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(severity_band(F.col("s")).alias("b")).first().b == band


def _attempts(spark):
    rows = [("run-1", "pyrit", "p-fail", 1, 0.8, 100), ("run-1", "pyrit", "p-fail", 2, 0.1, 200),
            ("run-1", "pyrit", "p-pass", 3, 0.2, 50)]
    return spark.createDataFrame(rows, "run_id string, suite string, probe string, attempt_id long, score double, latency_ms long")


def test_probe_verdicts_and_run_totals(spark):
    a = _attempts(spark)
    p = {r.probe: r for r in redteam.probe_verdicts(a).collect()}
    assert p["p-fail"].verdict == "fail" and p["p-fail"].findings == 1 and p["p-fail"].worst_severity == "high"
    assert p["p-pass"].verdict == "pass" and p["p-pass"].worst_severity is None and p["p-pass"].attempts == 1
    run = redteam.run_totals(a, redteam.probe_verdicts(a)).first()
    assert (run.probe_count, run.fail_count, run.duration_ms, run.n_high) == (2, 1, 350, 1)


def test_unknown_suite_and_missing_probe_rows(spark):
    p = redteam.probe_verdicts(_attempts(spark))
    u = redteam.suite_union(p, ["pyrit", "typo-suite"]).filter(F.col("verdict") == "error").collect()
    assert [(r.suite, r.probe, r.attempts) for r in u] == [("typo-suite", "<unknown-suite>", 0)]
    m = redteam.missing_probes(p, [("pyrit", "p-fail"), ("pyrit", "p-gone")]).collect()
    assert [(r.probe, r.verdict, r.attempts) for r in m] == [("p-gone", "error", 0)]


def test_worst_score_first_on_ties(spark):
    s = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "b", 0.7), (1, 2, "c", 0.7), (2, 0, "z", 0.1)],
                              "attempt_id long, pos long, scorer string, score double")
    out = {r.attempt_id: r for r in redteam.worst_score(s).collect()}
    assert out[1].worst_scorer == "b" and out[1].worst_score == 0.7
    assert out[2].worst_scorer == "z"


def test_decision_status_precedence(spark):
    df = spark.createDataFrame([(True, True, None), (True, False, "E"), (False, True, None), (False, False, "ValueError"),
                                (False, False, None)], "b boolean, e boolean, x string")
    got = [r.s for r in df.select(decision_status(F.col("b"), F.col("e"), F.col("x")).alias("s")).collect()]
    assert got == ["blocked_and_escalated", "guardrail_blocked", "escalation_requested", "ValueError", "ok"]


def test_emit_rows_maps_class(spark):
    a = _attempts(spark)
    p = redteam.probe_verdicts(a)
    rows = redteam.emit_rows(redteam.run_totals(a, p), p).collect()
    assert {r.row_class for r in rows} == {"redteam_run", "redteam_probe"}
    assert {r.allowlist_class for r in rows} == {"red_team_result"}
