"""Keyed PII redaction of attribute values and free text (GT13-GT15).

Redaction runs as column expressions: whitespace strip, regex analyzer,
HMAC-SHA-256 with the tenant key. A record whose value breaks the request
contract (over 64,000 characters, or a path outside 1-256 characters) is
dropped, as a failed redaction call drops the record (fail closed). A
user-supplied analyzer can replace the regex one through
``tracefold.functions.plugins.analyzer_udf``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions.hashing import hmac_sha256_hex
from tracefold.functions.pii import DEFAULT_ANALYZER, PatternAnalyzer, strip_whitespace
from tracefold.operators.gates import class_of


def request_valid(value: Column, path: Column) -> Column:
    """GT14: the redaction request contract, evaluated on the stripped value."""
    return ((F.char_length(value) <= C.REDACT_MAX_VALUE_CHARS)
            & (F.char_length(path) >= C.REDACT_PATH_MIN)
            & (F.char_length(path) <= C.REDACT_PATH_MAX))


def redact_value(value: Column, path: Column, key: bytes | str,
                 analyzer: PatternAnalyzer = DEFAULT_ANALYZER, category: Column | None = None) -> Column:
    """One redaction call as a struct ``(valid, value, hashed, pii_category)``.

    The value is stripped of surrounding whitespace before detection and
    hashing; without PII the stripped value is returned unhashed.
    ``category`` may carry a precomputed analyzer result (e.g. a plug-in UDF).
    """
    stripped = strip_whitespace(value)
    cat = analyzer.category(stripped) if category is None else category
    hashed = cat.isNotNull()
    return F.struct(
        request_valid(stripped, path).alias("valid"),
        F.when(hashed, hmac_sha256_hex(stripped, key)).otherwise(stripped).alias("value"),
        hashed.alias("hashed"),
        F.coalesce(cat, F.lit("")).alias("pii_category"),
    )


def redact_records(df: DataFrame, key: bytes | str, skip: Iterable[str] = (),
                   analyzer: PatternAnalyzer = DEFAULT_ANALYZER, attrs: str = "attrs",
                   class_attr: str = C.DEFAULT_CLASS_ATTRIBUTE) -> DataFrame:
    """GT13: redact every non-empty, non-skipped string attribute of a record.

    The request path is ``<class>.<key>`` (just ``<key>`` without a class).
    A value with PII is replaced by its keyed hash; values without PII are left
    as they were. Records with any invalid request are dropped. Adds
    ``pii_categories`` (sorted distinct) and ``n_hashed``.
    """
    skip = list(skip)
    m = F.col(attrs)
    cls = class_of(m, class_attr)
    out = df.withColumn("__cls", cls)
    c = F.col("__cls")

    def eligible(k: Column, v: Column) -> Column:
        e = (v["t"] == "str") & (v["s"] != F.lit(""))
        if skip:
            e = e & ~k.isin(skip)
        return e

    def path(k: Column) -> Column:
        return F.when(c == "", k).otherwise(F.concat(c, F.lit("."), k))

    # Contract check first: it only needs the stripped length, so the filter
    # stays cheap even where the optimizer moves it below the projection.
    valid = F.forall(F.map_entries(m), lambda e: ~eligible(e["key"], e["value"]) | request_valid(
        strip_whitespace(e["value"]["s"]), path(e["key"])))
    out = out.filter(valid)
    # One analysis and at most one hash per eligible value. Lambdas get no
    # common-subexpression elimination, so intermediates are bound with let_.
    calls = F.transform_values(m, lambda k, v: F.struct(
        v.alias("v"),
        F.when(eligible(k, v), let_(strip_whitespace(v["s"]), lambda st: let_(
            analyzer.category(st), lambda cat: F.struct(
                cat.isNotNull().alias("hashed"),
                F.when(cat.isNotNull(), hmac_sha256_hex(st, key)).alias("value"),
                cat.alias("pii_category"))))).alias("r")))
    out = out.withColumn("__r", calls)
    vals = F.map_values(F.col("__r"))
    hashed = F.filter(vals, lambda x: F.coalesce(x["r"]["hashed"], F.lit(False)))
    redacted = F.transform_values("__r", lambda k, x: F.when(
        F.coalesce(x["r"]["hashed"], F.lit(False)), x["v"].withField("s", x["r"]["value"])).otherwise(x["v"]))
    return out.select(*[F.col(c) for c in df.columns if c != attrs], redacted.alias(attrs),
                      F.array_sort(F.array_distinct(F.transform(hashed, lambda x: x["r"]["pii_category"])))
                      .alias("pii_categories"),
                      F.size(hashed).alias("n_hashed"))


def let_(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placeholder_redact(text: Column, analyzer: PatternAnalyzer = DEFAULT_ANALYZER) -> Column:
    """GT15: in-text PII replaced by ``<REDACTED:CATEGORY>`` for review views."""
    return analyzer.placeholders(text)
