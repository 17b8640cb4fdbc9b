import pytest
from helpers import plain, records_df
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import constants as C
from tracefold.operators import gates
from tracefold.schemas import ATTR_MAP, SPAN_EVENT, SPANS


def test_unlisted_attributes_stripped(spark):
    df = records_df(spark, [{"event_class": "decision_summary", "tenant_id": "t-1", "agent_id": "a-1",
                             "cost_usd": 0.01, "prompt_text": "secret", "internal_note": "x"}])
    out = [plain(r.attrs) for r in gates.guard_records(df).collect()]
    assert out == [{"event_class": "decision_summary", "tenant_id": "t-1", "agent_id": "a-1", "cost_usd": 0.01}]


@pytest.mark.parametrize("cls", [None, "not_a_class", 7])
def test_unknown_class_dropped_or_passed_untouched(spark, cls):
    row = {"tenant_id": "t-1", "foo": "bar"}
    if cls is not None:
        row["event_class"] = cls
    df = records_df(spark, [row])
    assert gates.guard_records(df).count() == 0
    passed = gates.guard_records(df, drop_unknown=False).collect()
    assert [plain(r.attrs) for r in passed] == [row]


def test_oversized_strings_removed_non_strings_exempt(spark):
    df = records_df(spark, [{"event_class": "decision_summary", "model": "m" * 9, "latency_ms": 123456789,
                             "decision_id": "é" * 5}])  # 10 UTF-8 bytes
    out = plain(gates.guard_records(df, max_bytes=8).first().attrs)
    assert "model" not in out and "decision_id" not in out
    assert out["latency_ms"] == 123456789
    out0 = plain(gates.guard_records(df, max_bytes=0).first().attrs)
    assert out0["model"] == "m" * 9  # 0 disables the cap


def test_extras_only_for_known_classes(spark):
    df = records_df(spark, [{"event_class": "escalation", "ticket": "T-1"},
                            {"event_class": "other", "ticket": "T-2"}])
    out = gates.guard_records(df, extra={"escalation": ["ticket"], "other": ["ticket"]}).collect()
    assert [plain(r.attrs) for r in out] == [{"event_class": "escalation", "ticket": "T-1"}]


def test_empty_record_dropped(spark):
    df = records_df(spark, [{"kind": "decision_summary", "junk": "x"}, {"kind": "decision_summary", "model": "m"}])
    out = gates.guard_records(df, class_attr="kind").collect()
    assert [plain(r.attrs) for r in out] == [{"model": "m"}]


def test_strip_counters(spark):
    df = records_df(spark, [{"event_class": "decision_summary", "a": 1, "b": 2, "model": "x" * 20},
                            {"event_class": "nope", "a": 1}])
    rows = {r.event_class: r for r in gates.strip_counters(df, max_bytes=17).collect()}
    assert rows["decision_summary"].n_stripped == 2 and rows["decision_summary"].n_oversized == 1
    assert rows["nope"].n_dropped == 1 and rows["decision_summary"].n_dropped == 0


def test_guard_typed_matches_map_guard(spark):
    df = spark.createDataFrame(
        [("decision_summary", "t", "a", 5, "note"), ("escalation", "t", "a", 7, None), ("bogus", "t", None, 1, "n")],
        "event_class string, tenant_id string, agent_id string, input_tokens long, internal_note string")
    out = gates.guard_typed(df, df.columns).orderBy("event_class").collect()
    assert [r.event_class for r in out] == ["decision_summary", "escalation"]
    assert out[0].input_tokens is None and out[0].internal_note is None
    assert out[1].tenant_id == "t"


def _span(spark, attrs, events, resource=None):
    def amap(d):
        from helpers import av
        return {k: av(v) for k, v in d.items()}
    row = ("t" * 32, "s" * 16, None, "decision.decision", 1, 1, 2, 1, None, "sc", amap(resource or {}), amap(attrs),
           [(n, 1, amap(a)) for n, a in events])
    return spark.createDataFrame([row], SPANS)


def test_span_prefixes_applied_to_span_events_and_resource(spark):
    attrs = {"decision.tenant_id": "t", "gen_ai.system": "x", "llm.model": "m", "tool.name": "n",
             "service.name": "s", "http.method": "GET", "db.system": "pg",
             "user.email": "a@b.c", "decisionx.spoof": "1"}
    df = _span(spark, attrs, [("ev", {"decision.guardrail.blocked": True, "host.name": "h"})],
               resource={"service.name": "svc", "k8s.pod": "p"})
    r = gates.guard_spans(df).first()
    assert set(plain(r.attrs)) == {k for k in attrs if k not in ("user.email", "decisionx.spoof")}
    assert plain(r.events[0].attrs) == {"decision.guardrail.blocked": True}
    assert plain(r.resource_attrs) == {"service.name": "svc"}


def test_span_drop_rule(spark):
    kept = _span(spark, {"foreign": "x"}, [("ev", {"decision.x": 1})])
    dropped = _span(spark, {"foreign": "x"}, [("ev", {"other": 1})])
    assert gates.guard_spans(kept).count() == 1
    assert gates.guard_spans(dropped).count() == 0
    assert gates.guard_spans(dropped, enabled=False).count() == 1


def test_typed_int_exempt_from_cap(spark):
    df = _span(spark, {"decision.count": 12345}, [])
    assert plain(gates.guard_spans(df, max_bytes=8).first().attrs) == {"decision.count": 12345}


def test_prefixes_must_be_namespaced(spark):
    with pytest.raises(ValueError):
        gates.prefix_allowed(F.col("k"), ["decision"])


def test_constants_shape():
    assert all(p.endswith(".") for p in C.default_span_prefixes())
    assert "event_class" in C.CLASS_ALLOWLIST["escalation"]
    assert SPAN_EVENT["attrs"].dataType == ATTR_MAP
    assert isinstance(SPANS, T.StructType)


def test_plans_stay_small(spark):
    """A computed attribute map stands in the plan once, not once for each use of a class's branch."""
    from tracefold.plans import QUERIES
    for name in ("gt1_class_allowlist", "gt3_unknown_class", "gt8_strip_counters"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 100_000, (name, len(plan))


def test_counters_reach_every_kind(spark):
    from tracefold.plans import QUERIES
    rows = {r.event_class: r for r in QUERIES["gt8_strip_counters"](spark, "/root/testdata/sf0.01").collect()}
    assert rows["decision_summary"].n_oversized > 0 and rows["decision_summary"].n_stripped > 0 and rows["unlisted_class"].n_dropped > 0


def test_guard_keeps_column_order_and_counts(spark):
    df = records_df(spark, [{"event_class": "escalation", "agent_id": "x" * 50, "foo": 1}, {"event_class": "nope", "a": "b"}, {}]).withColumn("after", F.lit(1))
    out = gates.guard_records(df, drop_unknown=False, max_bytes=20, with_counters=True)
    assert out.columns == ["rid", "attrs", "after", "known_class", "stripped", "oversized"]
    got = {r.rid: (r.known_class, r.stripped, r.oversized, sorted(r.attrs)) for r in out.collect()}
    assert got == {0: (True, 1, 1, ["event_class"]), 1: (False, 0, 0, ["a", "event_class"]), 2: (False, 0, 0, [])}
