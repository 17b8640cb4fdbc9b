"""Deterministic keyed samplers (GT11, GT12).

The bucket of a row is the first 8 bytes of HMAC-SHA-256(key, message),
compared against ``uint64(rate * 2**63) * 2``. Both sides are rendered as 16
hex digits so the unsigned comparison is a plain string comparison. The hash
is computed per row inside codegen; no distinct/join/shuffle is introduced,
which keeps the sampler a narrow map-side stage at any scale.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions.hashing import hmac_prefix_u64_hex, rate_threshold_hex


def _rate_keep(rate: float, bucket_hex: Column) -> Column:
    if rate >= 1.0:
        return F.lit(True)
    if rate <= 0.0:
        return F.lit(False)
    return bucket_hex < F.lit(rate_threshold_hex(rate))


def validate_rates(rates: Mapping[str, float], default_rate: float = C.SAMPLER_DEFAULT_RATE) -> None:
    for c, r in rates.items():
        if not c:
            raise ValueError("rates has an empty class key")
        if not 0.0 <= r <= 1.0:
            raise ValueError(f"rate for {c!r} outside [0, 1]")
    if not 0.0 <= default_rate <= 1.0:
        raise ValueError("default rate outside [0, 1]")


def sampler_keep(cls: Column, tenant: Column, agent: Column, key: bytes | str,
                 rates: Mapping[str, float], default_rate: float = C.SAMPLER_DEFAULT_RATE) -> Column:
    """GT11 keep flag: rate per class, bucket over ``tenant|agent|class``.

    Missing or non-string attributes count as ''. Rates >= 1 keep and <= 0
    drop without hashing.
    """
    validate_rates(rates, default_rate)
    sep = F.lit(C.SAMPLER_SEPARATOR)
    msg = F.concat(F.coalesce(tenant, F.lit("")), sep, F.coalesce(agent, F.lit("")), sep,
                   F.coalesce(cls, F.lit("")))
    bucket = hmac_prefix_u64_hex(msg, key)
    cls_ = F.coalesce(cls, F.lit(""))
    expr = None
    for c, r in rates.items():
        branch = _rate_keep(r, bucket)
        expr = F.when(cls_ == c, branch) if expr is None else expr.when(cls_ == c, branch)
    default = _rate_keep(default_rate, bucket)
    return default if expr is None else expr.otherwise(default)


def sample_records(df: DataFrame, key: bytes | str, rates: Mapping[str, float],
                   default_rate: float = C.SAMPLER_DEFAULT_RATE,
                   class_col: str = "event_class", tenant_col: str = "tenant_id",
                   agent_col: str = "agent_id") -> DataFrame:
    """GT11: keep a deterministic share of records per event class.

    A whole (tenant, agent, class) group is either in or out, so the same
    record always gets the same answer. If every rate is >= 1 the input is
    returned unchanged (the stage is omitted from the plan).
    """
    validate_rates(rates, default_rate)
    if default_rate >= 1.0 and all(r >= 1.0 for r in rates.values()):
        return df
    keep = sampler_keep(F.col(class_col), F.col(tenant_col), F.col(agent_col), key, rates, default_rate)
    return df.filter(keep)


def conditional_keep(rate: Column, key_cols: list[Column], key: bytes | str) -> Column:
    """GT12 keep flag: per-row rate chosen by content, bucket over the key.

    Any rate will do: the row's threshold is ``floor(rate * 2**63)``, compared
    with the upper 63 bits of the bucket, which is the rule of
    :func:`sampler_keep` for a rate that is a column. A null rate drops the row.
    """
    sep = F.lit(C.SAMPLER_SEPARATOR)
    parts = []
    for i, c in enumerate(key_cols):
        if i:
            parts.append(sep)
        parts.append(F.coalesce(c.cast("string"), F.lit("")))
    bucket = hmac_prefix_u64_hex(F.concat(*parts), key)
    # the 16 hex digits as a signed 64-bit number; shifted right without sign, its upper 63 bits
    signed = F.conv(bucket, 16, -10).cast("bigint")
    threshold = F.floor(rate.cast("double") * F.lit(float(1 << 63))).cast("bigint")
    return (F.when(rate >= 1.0, F.lit(True)).when(rate <= 0.0, F.lit(False)).when(rate.isNull() | F.isnan(rate.cast("double")), F.lit(False))
             .otherwise(F.shiftrightunsigned(signed, 1) < threshold))


def conditional_sample(df: DataFrame, rate_expr: Column, key: bytes | str,
                       key_cols: tuple[str, ...] = ("tenant_id", "decision_id"),
                       rate_col: str = "sample_rate") -> DataFrame:
    """GT12: content-dependent sampling (e.g. low score 100 %, else 5 %).

    The bucket is keyed by ``(tenant, decision_id)``, so the answer for one
    decision is reproducible across stages and runs.
    """
    out = df.withColumn(rate_col, rate_expr)
    keep = conditional_keep(F.col(rate_col), [F.col(c) for c in key_cols], key)
    return out.filter(keep)
