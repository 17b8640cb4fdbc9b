"""The deployed stage order on typed records: guard, redact, policy, sampler (SM1, SC5, AG8, AG9).

Each stage sees the record as the one before left it. ``staged`` keeps every row and names the first stage that
drops it; ``gated`` keeps the rows that no stage drops. Both are column expressions only, so they hold on a
stream as well and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions.hashing import hmac_sha256_hex
from tracefold.functions.pii import DEFAULT_ANALYZER, PatternAnalyzer, strip_whitespace
from tracefold.operators import gates, policy, sampling
from tracefold.operators.redaction import request_valid

#: In the order in which they see a record.
STAGES = ("schema", "redaction", "policy", "sampler")


def staged(df: DataFrame, attr_cols: Iterable[str], sampler_key: bytes | str, rates: Mapping[str, float],
           predicate: str | None = None, redact_key: bytes | str | None = None, skip: Iterable[str] = (),
           extra: Mapping[str, Iterable[str]] | None = None, max_bytes: int = C.DEFAULT_MAX_FIELD_BYTES,
           analyzer: PatternAnalyzer = DEFAULT_ANALYZER, class_col: str = "event_class",
           tenant_col: str = "tenant_id", agent_col: str = "agent_id") -> DataFrame:
    """All rows with the attributes as the stages leave them, and ``drop_reason``: the first of ``STAGES`` that
    drops the row, null if none does.

    - schema: the class is unknown, or no attribute of the record is left;
    - redaction (only with ``redact_key``): a value breaks the request contract. In other rows each string attribute
      not in ``skip`` that holds PII becomes its keyed hash, of the stripped value;
    - policy: ``predicate`` is not true of the guarded, redacted record;
    - sampler: the record's group is outside its class's rate.

    For each redacted attribute are added: ``oversized_<attr>`` (removed for its length), ``hashed_<attr>`` and
    ``category_<attr>``, the category it was hashed for. Attributes of an unknown class pass as they are; such rows are dropped at the first stage.
    """
    attr_cols = list(attr_cols)
    types, allow = dict(df.dtypes), gates.effective_allowlist(extra)
    texts = [c for c in attr_cols if types[c] == "string" and c not in {class_col, *skip}] if redact_key else []
    cls = F.coalesce(F.col(class_col), F.lit(""))

    def oversized(c: str) -> Column:
        allowed = cls.isin([k for k in allow if c in allow[k]])
        return F.coalesce(allowed & (F.octet_length(c) > max_bytes), F.lit(False)) if max_bytes > 0 else F.lit(False)

    known = cls.isin(list(allow))
    rows = df.select("*", known.alias("__known"), cls.alias("__cls"), *[oversized(c).alias(f"oversized_{c}") for c in texts])
    rows = gates.guard_typed(rows, attr_cols, extra, drop_unknown=False, max_bytes=max_bytes, class_col=class_col, drop_empty=False)
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in attr_cols], F.lit(False))

    valid, values, flags = F.lit(True), {}, []
    for c in texts:
        stripped = strip_whitespace(F.col(c))
        asked = F.coalesce(F.col("__known") & (F.col(c) != ""), F.lit(False))
        path = F.when(F.col("__cls") == "", F.lit(c)).otherwise(F.concat("__cls", F.lit(f".{c}")))
        category = F.when(asked, analyzer.category(stripped))
        hashed = category.isNotNull()
        valid = valid & (~asked | request_valid(stripped, path))
        values[c] = F.when(hashed, hmac_sha256_hex(stripped, redact_key)).otherwise(F.col(c))
        flags += [hashed.alias(f"hashed_{c}"), category.alias(f"category_{c}")]
    rows = rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in rows.columns], *flags,
                       valid.alias("__valid"), (F.col("__known") & some).alias("__schema"))
    rows = policy.with_policy_flag(rows, predicate, "__policy") if predicate else rows.withColumn("__policy", F.lit(True))
    keep = sampling.sampler_keep(F.col(class_col), F.col(tenant_col), F.col(agent_col), sampler_key, rates)
    passed = (F.col("__schema"), F.col("__valid"), F.col("__policy"), keep)
    reason = F.coalesce(*[F.when(~ok, F.lit(stage)) for stage, ok in zip(STAGES, passed, strict=True)])
    return rows.withColumn("drop_reason", reason).drop("__known", "__cls", "__valid", "__schema", "__policy")


def gated(df: DataFrame, *args, **kwargs) -> DataFrame:
    """The rows of :func:`staged` that no stage drops, in the columns of ``df``."""
    return staged(df, *args, **kwargs).filter(F.col("drop_reason").isNull()).select(df.columns)
