"""Policy predicates and narrowing rule sets (GT9, GT10, GT21, GT26).

A policy is a Spark SQL boolean expression over the record's columns. It is
parsed and resolved once per plan and evaluated in codegen. It fails closed: a
null result, an error while it is evaluated (division by zero, overflow, a bad
cast, an index out of bounds, ``raise_error``), a non-boolean expression and
one that can't be made total keep nothing (see ``predicates``). The session's
settings are not touched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.predicates import fail_closed


def policy_gate(df: DataFrame, predicate: str | None) -> DataFrame:
    """GT9: keep rows where ``predicate`` is true without an error; no policy means no-op."""
    return df.filter(fail_closed(df, predicate)) if predicate else df


def with_policy_flag(df: DataFrame, predicate: str, out: str = "policy_ok") -> DataFrame:
    """GT9 as a column: ``out`` is true where the policy keeps the row.

    Same rule as :func:`policy_gate`; used when a pipeline records which
    stage dropped a row instead of dropping it.
    """
    return df.withColumn(out, fail_closed(df, predicate))


@dataclass(frozen=True)
class RuleSet:
    """GT10 narrowing rules: allow lists, deny lists and drop patterns per column."""

    allow: Mapping[str, Sequence[str]] = field(default_factory=dict)
    deny: Mapping[str, Sequence[str]] = field(default_factory=dict)
    drop_patterns: Mapping[str, str] = field(default_factory=dict)


def apply_rules(df: DataFrame, rules: RuleSet) -> DataFrame:
    """GT10: AND of every rule; rules can only narrow what passes.

    Allow lists keep rows whose value is listed (null is not listed); deny
    lists drop listed values; drop patterns drop rows whose column matches.
    Lists are config and become one set literal each, whatever their length,
    so rows stay where they are and columns keep their order.
    """
    out = df
    for col, values in rules.allow.items():
        out = out.filter(F.coalesce(F.col(col).isin(list(values)), F.lit(False)))
    for col, values in rules.deny.items():
        out = out.filter(F.coalesce(~F.col(col).isin(list(values)), F.lit(True)))
    for col, pattern in rules.drop_patterns.items():
        out = out.filter(F.coalesce(~F.col(col).rlike(pattern), F.lit(True)))
    return out


def equality_filter(filters: Mapping[str, str], resolve) -> Column:
    """AND of ``resolve(name) == value`` comparisons made on text renderings."""
    cond = F.lit(True)
    for name, value in filters.items():
        cond = cond & F.coalesce(resolve(name) == F.lit(value), F.lit(False))
    return cond


def saved_view(df: DataFrame, filters: Mapping[str, str], resolve, ts_col: str = "ts") -> DataFrame:
    """GT21: a saved view, i.e. equality filters, newest first."""
    return df.filter(equality_filter(filters, resolve)).orderBy(F.col(ts_col).desc())


def saved_view_attrs(df: DataFrame, filters: Mapping[str, str], attrs: str = "attrs",
                     ts_col: str = "ts") -> DataFrame:
    """GT21 over attribute maps: values are rendered to text once per record
    (one map transform), then each filter is a cheap lookup in that map."""
    from tracefold.schemas import attr_as_text
    txt = df.withColumn("__txt", F.transform_values(attrs, lambda k, v: attr_as_text(v)))
    return saved_view(txt, filters, lambda name: F.col("__txt")[name], ts_col).drop("__txt")


def tenant_scope(df: DataFrame, tenant: str, tenant_col: str = "tenant_id") -> DataFrame:
    """GT26: every read scoped to one tenant (a partition filter when the
    table is written partitioned by tenant)."""
    return df.filter(F.col(tenant_col) == F.lit(tenant))


def with_score_columns(decisions: DataFrame, scores: DataFrame, rubrics, key: str = "decision_id",
                       rubric_col: str = "rubric", score_col: str = "score") -> DataFrame:
    """GT21: judge scores addressable as ``score.<rubric>`` columns.

    Scores are pivoted with the explicit rubric list (no extra pass to find
    the values) into one row per decision, then left-joined one-to-one.
    """
    rubrics = list(rubrics)
    p = scores.groupBy(key).pivot(rubric_col, rubrics).agg(F.min(score_col))
    p = p.select(key, *[F.col(f"`{r}`").cast("double").alias(f"score.{r}") for r in rubrics])
    return decisions.join(p, key, "left")


def column_resolver(df_columns):
    """Resolve saved-view filter names: ``score.<rubric>`` and plain columns as text."""
    def resolve(name: str):
        if name in df_columns:
            return F.col(f"`{name}`").cast("string")
        raise KeyError(f"saved-view filter on unknown field {name!r}")
    return resolve
