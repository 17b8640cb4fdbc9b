"""Label, status and formatting column builders (FN5-FN8, FN10, FN11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold import constants as C


def decision_status(blocked: Column, escalated: Column, exception: Column | None = None) -> Column:
    """FN5: status description with precedence block+escalation > block >
    escalation > exception class name > ok."""
    b = F.coalesce(blocked, F.lit(False))
    e = F.coalesce(escalated, F.lit(False))
    expr = (F.when(b & e, F.lit(C.STATUS_BLOCKED_AND_ESCALATED))
             .when(b, F.lit(C.STATUS_BLOCKED))
             .when(e, F.lit(C.STATUS_ESCALATED)))
    if exception is not None:
        expr = expr.when(exception.isNotNull(), exception)
    return expr.otherwise(F.lit(C.STATUS_OK))


def severity_band(score: Column) -> Column:
    """FN6: score in [0, 1] -> critical / high / medium / low / info."""
    expr = None
    for bound, band in C.SEVERITY_BANDS:
        cond = score >= F.lit(bound)
        expr = F.when(cond, F.lit(band)) if expr is None else expr.when(cond, F.lit(band))
    return expr.otherwise(F.lit("info"))


def is_finding(score: Column) -> Column:
    """FN6: a score-based attempt is a finding iff score >= 0.5."""
    return score >= F.lit(C.FINDING_MIN)


def severity_rank(band: Column) -> Column:
    """Ordinal of a severity band (info=0 ... critical=4) for max/sort."""
    return F.array_position(F.array(*[F.lit(s) for s in C.SEVERITIES]), band) - 1


def policy_ids(prefix: str, names: Column) -> Column:
    """FN7: ``<prefix>:<name>`` for each element of an array column."""
    return F.transform(names, lambda n: F.concat(F.lit(prefix + ":"), n))


def entity_label(category: Column, count: Column) -> Column:
    """FN7: ``category:count``."""
    return F.concat(category, F.lit(":"), count.cast("string"))


def trace_id_hex(n: Column) -> Column:
    """FN8: 32-hex trace id from an integer id."""
    return F.lpad(F.lower(F.hex(n)), 32, "0")


def redaction_path(cls: Column, key: Column) -> Column:
    """FN8: ``<class>.<key>``, or just ``<key>`` without a class."""
    return F.when(F.coalesce(cls, F.lit("")) == "", key).otherwise(F.concat(cls, F.lit("."), key))


def _json_value(v: Column) -> Column:
    quoted = F.regexp_replace(F.regexp_replace(F.to_json(F.array(v["s"])), r"^\[", ""), r"\]$", "")
    return (F.when(v["t"] == "str", quoted)
             .when(v["t"] == "bool", F.lower(v["b"].cast("string")))
             .when(v["t"] == "int", v["i"].cast("string"))
             .when(v["t"] == "double", v["d"].cast("string"))
             .when(v["t"] == "json", v["j"])
             .otherwise(F.lit("null")))


def attrs_to_json(attrs: Column) -> Column:
    """FN10: an attribute map as plain JSON text with sorted keys.

    Strings are quoted and escaped, numbers and booleans are bare, nested
    maps/lists (kept as JSON text) are embedded as they are.
    """
    keys = F.array_sort(F.map_keys(attrs))
    parts = F.transform(keys, lambda k: F.concat(
        F.regexp_replace(F.regexp_replace(F.to_json(F.array(k)), r"^\[", ""), r"\]$", ""),
        F.lit(":"), _json_value(attrs[k])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def escalation_payload(reason: Column, mode: Column, rubric_id: Column | None = None,
                       triggering_score: Column | None = None, kind: str = "decision.escalation") -> Column:
    """FN11: escalation payload JSON; optional fields appear only when set."""
    fields = [F.lit(kind).alias("kind"), reason.alias("reason"), mode.alias("mode")]
    if rubric_id is not None:
        fields.append(rubric_id.alias("rubric_id"))
    if triggering_score is not None:
        fields.append(triggering_score.cast("double").alias("triggering_score"))
    return F.to_json(F.struct(*fields))
