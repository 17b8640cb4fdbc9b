"""Record contracts, identity normalisation and projections (GT18-GT20, GT22, GT24, GT25, GT27).

Validation never raises: each rule that fails adds a reason code to a
``reasons`` array, and the frame splits on ``size(reasons)`` into valid rows
and a quarantine, so one bad row cannot fail a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions.hashing import sha256_hex
from tracefold.functions.pii import DEFAULT_ANALYZER, PatternAnalyzer, strip_whitespace


def with_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reasons") -> DataFrame:
    """Add ``reasons`` (codes of failed rules, in rule order) and ``valid``.

    A rule is ``(code, failed_condition)``; a null condition counts as failed
    only if the rule says so through ``coalesce``.
    """
    arr = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules])
    return (df.withColumn(out, F.filter(arr, lambda x: x.isNotNull()))
              .withColumn("valid", F.size(F.col(out)) == 0))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reasons)."""
    return df.filter(F.col("valid")).drop("reasons", "valid"), df.filter(~F.col("valid"))


def retrieval_rules(df: DataFrame) -> list[tuple[str, Column]]:
    """GT18 rules for retrieval events."""
    rules = [
        ("missing_decision_id", F.col("decision_id").isNull()),
        ("bad_source", ~F.coalesce(F.col("source").isin(list(C.RETRIEVAL_SOURCES)), F.lit(False))),
        ("bad_query_hash", ~F.coalesce(F.col("query_hash").rlike(C.SHA256_HEX_PATTERN), F.lit(False))),
        ("negative_result_count", F.col("result_count") < 0),
    ]
    if "n_result_hashes" in df.columns:
        rules.append(("result_hash_count_mismatch",
                      F.col("n_result_hashes").isNotNull() & (F.col("n_result_hashes") != F.col("result_count"))))
    return rules


def memory_rules() -> list[tuple[str, Column]]:
    return [
        ("missing_decision_id", F.col("decision_id").isNull()),
        ("bad_kind", ~F.coalesce(F.col("kind").isin(list(C.MEMORY_KINDS)), F.lit(False))),
        ("bad_content_hash", ~F.coalesce(F.col("content_hash").rlike(C.SHA256_HEX_PATTERN), F.lit(False))),
        ("negative_ttl", F.col("ttl_seconds") < 0),
    ]


def escalation_rules() -> list[tuple[str, Column]]:
    n = F.char_length(F.col("reason"))
    return [
        ("bad_reason_length", F.coalesce((n < C.REASON_MIN_CHARS) | (n > C.REASON_MAX_CHARS), F.lit(True))),
        ("bad_mode", ~F.coalesce(F.col("mode").isin(list(C.ESCALATION_MODES)), F.lit(False))),
    ]


def normalize_identity(df: DataFrame, cols: Sequence[str] = ("tenant_id", "agent_id", "profile"),
                       default_profile: str = C.DEFAULT_PROFILE) -> DataFrame:
    """GT19: strip identity fields (Python whitespace rules), default the
    profile, and flag ids that are empty after stripping."""
    out = df
    if "profile" in cols and "profile" not in df.columns:
        out = out.withColumn("profile", F.lit(default_profile))
    for c in cols:
        out = out.withColumn(c, strip_whitespace(F.col(c)))
    rules = [(f"empty_{c}", F.coalesce(F.col(c), F.lit("")) == "") for c in cols]
    return with_reasons(out, rules)


def coalesce_namespaces(attrs: Column, pairs: Sequence[tuple[str, str, str, str]]) -> list[Column]:
    """GT20: one typed column per field from either attribute namespace.

    ``pairs`` holds ``(out_name, kind, key_a, key_b)``; the first namespace wins.
    """
    field = {"str": "s", "int": "i", "double": "d", "bool": "b", "json": "j"}
    cols = []
    for out, kind, a, b in pairs:
        f = field[kind]
        cols.append(F.coalesce(attrs[a][f], attrs[b][f]).alias(out))
    return cols


def score_conformance(df: DataFrame, name_col: str = "rubric", score_col: str = "score",
                      configs=C.SCORE_CONFIGS) -> DataFrame:
    """GT22: check each score against its config: numeric range, category
    label/value, boolean 0/1; unknown config names do not conform."""
    s = F.col(score_col).cast("double")
    name = F.col(name_col)
    ok = None
    reason = None
    for cfg in configs:
        is_cfg = name == F.lit(cfg["name"])
        if cfg["data_type"] == "NUMERIC":
            lo, hi = cfg.get("min_value"), cfg.get("max_value")
            cond = F.lit(True)
            if lo is not None:
                cond = cond & (s >= F.lit(lo))
            if hi is not None:
                cond = cond & (s <= F.lit(hi))
            why = F.lit("out_of_range")
        elif cfg["data_type"] == "CATEGORICAL":
            cond = s.isin([v for _, v in cfg["categories"]])
            why = F.lit("not_a_category")
        else:
            cond = s.isin([0.0, 1.0])
            why = F.lit("not_boolean")
        cond = F.coalesce(cond, F.lit(False))
        ok = F.when(is_cfg, cond) if ok is None else ok.when(is_cfg, cond)
        reason = F.when(is_cfg, F.when(~cond, why)) if reason is None else reason.when(is_cfg, F.when(~cond, why))
    return df.withColumn("conforms", ok.otherwise(F.lit(False))).withColumn(
        "reason", reason.otherwise(F.lit("unknown_config")))


def content_projection(text: Column, policy: Column, analyzer: PatternAnalyzer = DEFAULT_ANALYZER) -> Column:
    """GT24: what is stored for a text under ``hash-only`` / ``redacted`` / ``full``."""
    return (F.when(policy == "full", text)
             .when(policy == "redacted", analyzer.placeholders(text))
             .otherwise(F.lit(None).cast("string")))


def content_record(df: DataFrame, text_col: str, policy: Column) -> DataFrame:
    """GT24: hash always, content per policy."""
    return (df.withColumn("content_policy", policy)
              .withColumn("content_hash", sha256_hex(text_col))
              .withColumn("content", content_projection(F.col(text_col), F.col("content_policy"))))


def retention_filter(df: DataFrame, as_of: str, ts_col: str = "ts", ttl_col: str | None = "ttl_seconds",
                     retention_days: int | None = None) -> DataFrame:
    """GT25: keep rows not yet expired at ``as_of``: ``ts + ttl > as_of`` when a
    TTL is set, and ``ts > as_of - retention`` for the profile retention."""
    t = F.lit(as_of).cast("timestamp_ntz")
    cond = F.lit(True)
    if ttl_col is not None:
        cond = cond & (F.col(ttl_col).isNull()
                       | (F.col(ts_col) + F.make_dt_interval(secs=F.col(ttl_col).cast("decimal(18,6)")) > t))
    if retention_days is not None:
        cond = cond & (F.col(ts_col) > t - F.make_dt_interval(days=F.lit(retention_days)))
    return df.filter(cond)


def previews(text: Column, n: int = C.PREVIEW_CHARS) -> list[Column]:
    """GT27: first ``n`` characters and the character count."""
    return [F.left(text, F.lit(n)).alias("preview"), F.char_length(text).alias("n_chars")]
