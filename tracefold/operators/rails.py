"""Phrase-list rails and the guardrail chain (GT16, GT17).

A rail set is a ranked list of rules ``(phrase, action, rail, block_response)``;
the first rule whose phrase occurs in the text (case-insensitive, literal
substring) decides. The rule list is small fixed config, so it compiles to a
``CASE`` chain evaluated in codegen. Matching is literal, not the dialogue
engine's semantic matching; operators extend the phrase list instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions.hashing import hmac_sha256_hex
from tracefold.functions.pii import DEFAULT_ANALYZER, PatternAnalyzer, strip_whitespace
from tracefold.operators.redaction import request_valid


@dataclass(frozen=True)
class RailRule:
    phrase: str
    action: str          # allow | redact | block | warn; anything else acts as block
    rail: str
    block_response: str | None = None
    rewrite_prefix: str = ""  # for warn/redact: text put before the content


def starter_rules() -> tuple[RailRule, ...]:
    """The starter jailbreak rail: every phrase blocks with the refusal."""
    return tuple(RailRule(p, "block", C.JAILBREAK_RAIL, C.JAILBREAK_REFUSAL) for p in C.JAILBREAK_PHRASES)


def _norm_action(action: str) -> str:
    return action if action in C.RAIL_ACTIONS else "block"


def check_rails(text: Column, rules: Sequence[RailRule] | None = None, default_rail: str = "passthrough") -> Column:
    """GT17: struct ``(allowed, action, rail, block_response, modified_value)``.

    Without ``rules`` the starter set is used; an empty list lets every text pass.
    Unknown actions fail closed to ``block``. A block empties the content; a
    warn or redact rewrites it with the rule's prefix.
    """
    rules = starter_rules() if rules is None else tuple(rules)
    low = F.lower(text)

    def result(action: str, rail: str, response: str | None, modified: Column) -> Column:
        action = _norm_action(action)
        return F.struct(F.lit(action in ("allow", "redact", "warn")).alias("allowed"),
                        F.lit(action).alias("action"), F.lit(rail).alias("rail"),
                        F.lit(response).cast("string").alias("block_response"),
                        modified.alias("modified_value"))

    expr = None
    for r in rules:
        act = _norm_action(r.action)
        if act == "block":
            mod = F.lit("")
        elif act in ("warn", "redact"):
            mod = F.concat(F.lit(r.rewrite_prefix), text)
        else:
            mod = text
        cond = low.contains(r.phrase.lower())
        res = result(act, r.rail, r.block_response, mod)
        expr = F.when(cond, res) if expr is None else expr.when(cond, res)
    default = result("allow", default_rail, None, text)
    return default if expr is None else expr.otherwise(default)


def guard_text(df: DataFrame, text_col: str, path_col: Column | str, key: bytes | str,
               rules: Sequence[RailRule] | None = None, analyzer: PatternAnalyzer | None = DEFAULT_ANALYZER,
               use_rails: bool = True, out: str = "guard") -> DataFrame:
    """GT16: redact, then run the rails on the redacted text.

    Adds a struct column ``out`` with ``blocked, block_response, content,
    entities (category:count), policies (pii:<CAT>, rail:<name>), action,
    rail, valid``. The redacted (stripped or hashed) value always replaces the text.

    A text that breaks the redaction request contract (too long after stripping, path missing, empty or too long) is
    neither analyzed nor passed on: ``valid`` is false, ``blocked`` true, ``action`` is ``error`` and ``content`` null.
    A null text asks for nothing and is valid; without an analyzer there is no such request.
    """
    path = F.col(path_col) if isinstance(path_col, str) else path_col
    text = F.col(text_col)
    if analyzer is not None:
        stripped = strip_whitespace(text)
        df = df.withColumn("__valid", text.isNull() | F.coalesce(request_valid(stripped, path), F.lit(False)))
        ok = F.col("__valid")
        df = df.withColumn("__cat", F.when(ok, analyzer.category(stripped))).withColumn("__content", F.when(
            ok, F.when(F.col("__cat").isNotNull(), hmac_sha256_hex(stripped, key)).otherwise(stripped)))
    else:
        df = df.withColumn("__valid", F.lit(True)).withColumn("__cat", F.lit(None).cast("string")).withColumn("__content", text)
    if use_rails:
        df = df.withColumn("__rail", check_rails(F.col("__content"), rules))
    else:
        df = df.withColumn("__rail", F.struct(
            F.lit(True).alias("allowed"), F.lit("allow").alias("action"), F.lit("none").alias("rail"),
            F.lit(None).cast("string").alias("block_response"), F.col("__content").alias("modified_value")))
    cat_c, rail_c, valid = F.col("__cat"), F.col("__rail"), F.col("__valid")
    entities = F.filter(F.array(F.when(cat_c.isNotNull(), F.concat(cat_c, F.lit(":1")))), lambda x: x.isNotNull())
    policies = F.filter(F.array(
        F.when(cat_c.isNotNull(), F.concat(F.lit("pii:"), cat_c)),
        F.when(valid & (rail_c["action"] != "allow"), F.concat(F.lit("rail:"), rail_c["rail"]))), lambda x: x.isNotNull())
    blocked = rail_c["action"] == "block"
    return df.withColumn(out, F.struct(
        (blocked | ~valid).alias("blocked"),
        F.when(valid & blocked, rail_c["block_response"]).alias("block_response"),
        F.when(valid, rail_c["modified_value"]).alias("content"),
        entities.alias("entities"),
        policies.alias("policies"),
        F.when(valid, rail_c["action"]).otherwise("error").alias("action"),
        F.when(valid, rail_c["rail"]).otherwise("none").alias("rail"),
        valid.alias("valid"),
    )).drop("__valid", "__cat", "__content", "__rail")
