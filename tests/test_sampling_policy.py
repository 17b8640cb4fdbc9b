import hashlib
import hmac

import pytest
from helpers import records_df
from pyspark.sql import functions as F

from tracefold.functions.hashing import hmac_pads, hmac_sha256_hex, rate_threshold_hex
from tracefold.operators import policy, sampling

KEY = b"unit-test-key"


@pytest.mark.parametrize("msg", ["", "tenant|agent|class", "héllo wörld", "日本語", "x" * 200])
def test_hmac_matches_python(spark, msg):
    got = spark.createDataFrame([(msg,)], "m string").select(hmac_sha256_hex("m", KEY).alias("h")).first().h
    assert got == hmac.new(KEY, msg.encode(), hashlib.sha256).hexdigest()


def test_long_key_is_hashed_first():
    long_key = b"k" * 100
    ipad, _ = hmac_pads(long_key)
    assert len(ipad) == 128


def test_threshold_formula():
    assert rate_threshold_hex(0.5) == "8000000000000000"
    with pytest.raises(ValueError):
        rate_threshold_hex(1.0)


def test_sampling_ratio_over_many_agents(spark):
    df = spark.range(5000).select(F.lit("decision_summary").alias("event_class"), F.lit("t-1").alias("tenant_id"),
                                  F.concat(F.lit("agent-"), F.col("id").cast("string")).alias("agent_id"))
    kept = sampling.sample_records(df, KEY, {"decision_summary": 0.3}).count()
    assert abs(kept / 5000 - 0.3) <= 0.03


def test_sampling_is_deterministic(spark):
    df = spark.createDataFrame([("decision_summary", "t", "a")] * 50, "event_class string, tenant_id string, agent_id string")
    kept = sampling.sample_records(df, KEY, {"decision_summary": 0.5}).count()
    assert kept in (0, 50)


def test_rate_edges_and_missing_attrs(spark):
    df = spark.createDataFrame([("x", None, None)], "event_class string, tenant_id string, agent_id string")
    assert sampling.sample_records(df, KEY, {"x": 1.0}) is df
    assert sampling.sample_records(df, KEY, {"x": 0.0}).count() == 0
    # missing attributes hash as '' (no error)
    sampling.sample_records(df, KEY, {"x": 0.5}).count()
    with pytest.raises(ValueError):
        sampling.sample_records(df, KEY, {"x": 1.5})


def test_policy_keeps_one_of_three(spark):
    df = spark.createDataFrame([("decision_summary", "t-1"), ("escalation", "t-1"), ("decision_summary", "t-2")],
                               "event_class string, tenant_id string")
    out = policy.policy_gate(df, "event_class = 'decision_summary' AND tenant_id = 't-1'")
    assert out.count() == 1


def test_policy_fails_closed(spark):
    df = spark.createDataFrame([(0, "a")], "zero int, s string")
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.ansi.enabled")
    assert policy.policy_gate(df, "1 / zero > 0").count() == 0   # division by zero -> drop
    assert policy.policy_gate(df, "s").count() == 0               # non-boolean -> drop all
    assert policy.policy_gate(df, None).count() == 1              # no policy -> no-op
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.ansi.enabled")) == before


POLICY_ROWS = """SELECT * FROM VALUES
  (1, 9223372036854775807L, 'a', array(1, 2), map('k', 'v'), 0, CAST(NULL AS INT), named_struct('x', 5), 1.5D),
  (2, 5L, '7', array(1, 2, 3), map('j', 'v'), 2, 3, named_struct('x', -5), 0D) AS t(id, n, s, arr, m, z, q, st, d)"""
#: predicate -> ids kept; row 1 makes each of the first group fail.
POLICIES = {
    "n + 1 > 0": [2], "n + 1 < 0": [], "n * 2 <> 0": [2], "-n - 2 < 0": [2],
    "CAST(s AS INT) > 0": [2], "s > 3": [2], "s::INT = 7": [2], "CAST('2024-13-01' AS DATE) IS NULL": [],
    "arr[2] = 3": [2], "arr[2] IS NULL": [], "element_at(arr, 3) = 3": [2], "element_at(arr, 0) IS NULL": [],
    "10 / z > 1": [2], "n % z = 1": [2], "n DIV z = 2": [2], "d / 0 > 1": [],
    "raise_error('x')": [], "IF(id = 2, true, raise_error('x'))": [2], "assert_true(id = 2) IS NULL": [2],
    # an error is no null: nothing may turn it into an answer
    "coalesce(10 / z, 100) > 1": [2], "10 / z IS NULL": [], "NOT (10 / z > 1)": [], "(10 / z) <=> NULL": [], "z IN (0, 10 / z)": [],
    # but a branch that isn't evaluated doesn't fail
    "z = 0 OR 10 / z > 1": [1, 2], "z <> 0 AND 10 / z > 1": [2], "CASE WHEN id = 2 THEN true ELSE CAST(s AS INT) > 0 END": [2],
    "coalesce(n, 10 / z) > 0": [1, 2], "id = 1 AND try_cast(s AS INT) IS NULL": [1],
    # total expressions keep their meaning, nulls included
    "m['k'] = 'v'": [1], "m['k'] IS NULL": [2], "q IS NULL": [1], "q IN (3, 4)": [2], "nvl(q, 1) = 1": [1], "n BETWEEN 1 AND 10": [2],
    "st.x > 0": [1], "upper(s) = 'A'": [1], "s LIKE 'a%'": [1], "s RLIKE '^a'": [1], "array_contains(arr, 3)": [2], "abs(st.x) = 5": [1, 2],
    # refused: may fail and have no total form
    "s RLIKE '^[a'": [], "rand() < 2": [], "round(d) > -1": [],
}


@pytest.mark.parametrize("predicate", sorted(POLICIES))
def test_policy_errors_drop_their_row_only(spark, predicate):
    df = spark.sql(POLICY_ROWS)
    assert sorted(r.id for r in policy.policy_gate(df, predicate).collect()) == POLICIES[predicate]
    flags = {r.id: r.policy_ok for r in policy.with_policy_flag(df, predicate).collect()}
    assert flags == {i: i in POLICIES[predicate] for i in (1, 2)}


def test_policy_of_a_user_function_is_refused(spark):
    from tracefold.operators.predicates import refusal
    spark.udf.register("user_rule", lambda x: 1 // 0 == x, "boolean")
    df = spark.range(3)
    assert "PythonUDF" in refusal(df, "user_rule(id)") and refusal(df, "id > 1") is None
    assert policy.policy_gate(df, "user_rule(id)").count() == 0
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        policy.policy_gate(df, "no_such_column > 1")


def test_rule_set_narrows(spark):
    df = spark.createDataFrame([("a-1", "t-1", "ok"), ("a-2", "t-1", "ok"), ("a-1", "t-9", "ok"), ("a-1", "t-1", "BAD")],
                               "agent_id string, tenant_id string, note string")
    rules = policy.RuleSet(allow={"tenant_id": ["t-1"]}, deny={"agent_id": ["a-2"]}, drop_patterns={"note": "BAD"})
    assert policy.apply_rules(df, rules).count() == 1


def test_conditional_sampler_low_scores_always_kept(spark):
    df = spark.range(2000).select(F.col("id").alias("decision_id"), F.lit("t").alias("tenant_id"),
                                  (F.col("id") % 10 / 10).alias("score"))
    rate = F.when(F.col("score") < 0.2, F.lit(1.0)).otherwise(F.lit(0.05))
    out = sampling.conditional_sample(df, rate, KEY)
    assert out.filter(F.col("score") < 0.2).count() == 400
    hi = out.filter(F.col("score") >= 0.2).count()
    assert 40 <= hi <= 120


def test_conditional_sampler_takes_any_rate(spark):
    df = spark.range(4000).select(F.col("id").alias("decision_id"), F.lit("t").alias("tenant_id"))
    for rate, low, high in ((0.9, 3500, 3700), (0.371, 1380, 1590), (1e-12, 0, 1)):
        assert low <= sampling.conditional_sample(df, F.lit(rate), KEY).count() <= high
    by_row = F.when(F.col("decision_id") % 4 == 0, 1.5).when(F.col("decision_id") % 4 == 1, 0.0).when(F.col("decision_id") % 4 == 2, -1.0)
    assert sampling.conditional_sample(df, by_row, KEY).filter("decision_id % 4 <> 0").count() == 0
    # a column's rate and a literal's keep the same rows
    cls = df.withColumn("event_class", F.lit("c")).withColumn("agent_id", F.col("decision_id").cast("string"))
    a = sampling.sample_records(cls, KEY, {"c": 0.3}).select("decision_id")
    b = cls.filter(sampling.conditional_keep(F.lit(0.3), [F.col("tenant_id"), F.col("agent_id"), F.col("event_class")], KEY)).select("decision_id")
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_long_rule_lists_keep_the_columns(spark):
    df = spark.createDataFrame([("a-1", "t-1", "ok")], "agent_id string, tenant_id string, note string")
    rules = policy.RuleSet(allow={"tenant_id": [f"t-{i}" for i in range(5000)]}, deny={"agent_id": [f"b-{i}" for i in range(5000)]})
    out = policy.apply_rules(df, rules)
    assert out.columns == df.columns and out.count() == 1


def test_records_helper(spark):
    assert records_df(spark, [{"a": 1}]).count() == 1


def test_hmac_key_material_redacted_from_plans(spark):
    import contextlib
    import io
    ipad, opad = hmac_pads(KEY)
    df = spark.createDataFrame([("x",)], "m string").select(hmac_sha256_hex("m", KEY).alias("h"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(True)
    text = buf.getvalue()
    assert "sha2" in text
    assert ipad not in text and opad not in text
