"""User plug-ins as Arrow-batched pandas UDFs (UD1-UD3).

Built-in analyzers, rails and gates are native column expressions; these
wrappers exist for users who bring their own Python analyzer, rail engine or
judge. Each call receives a whole Arrow batch, never one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import constants as C

ANALYSIS = T.StructType([T.StructField("has_pii", T.BooleanType()), T.StructField("category", T.StringType())])
RAIL_RESULT = T.StructType([
    T.StructField("allowed", T.BooleanType()), T.StructField("action", T.StringType()),
    T.StructField("rail", T.StringType()), T.StructField("block_response", T.StringType()),
    T.StructField("modified_value", T.StringType())])


def analyzer_udf(analyze: Callable[[str], tuple[bool, str]]):
    """UD1: ``text -> (has_pii, category)`` as a struct-returning pandas UDF.

    Feed the category into ``redaction.redact_value(category=...)``.
    """
    @F.pandas_udf(ANALYSIS)
    def run(text: pd.Series) -> pd.DataFrame:
        res = [analyze(t) if t is not None else (False, "") for t in text]
        return pd.DataFrame({"has_pii": [bool(r[0]) for r in res],
                             "category": [(r[1] or "") if r[0] else None for r in res]})
    return run


def rails_udf(check: Callable[[str, str, str], tuple[str, str, str | None, str]]):
    """UD2: ``(phase, path, text) -> (action, rail, block_response, text)``.

    Unknown actions fail closed to ``block``.
    """
    @F.pandas_udf(RAIL_RESULT)
    def run(phase: pd.Series, path: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for ph, pa, tx in zip(phase, path, text):
            action, rail, resp, mod = check(ph, pa, tx if tx is not None else "")
            if action not in C.RAIL_ACTIONS:
                action = "block"
            rows.append((action in ("allow", "redact", "warn"), action, rail, resp, mod))
        return pd.DataFrame(rows, columns=["allowed", "action", "rail", "block_response", "modified_value"])
    return run


def judge_udf(score: Callable[[str, str], float]):
    """UD3: ``(prompt, response) -> score in [0, 1]`` (clipped)."""
    @F.pandas_udf(T.DoubleType())
    def run(prompt: pd.Series, response: pd.Series) -> pd.Series:
        vals = [score(p or "", r or "") for p, r in zip(prompt, response)]
        return pd.Series(vals, dtype="float64").clip(0.0, 1.0)
    return run


def escalate_on(score: Column, threshold: float = C.ESCALATION_SCORE_THRESHOLD) -> Column:
    """UD3 routing: a judged decision escalates below the threshold."""
    return score < F.lit(threshold)


# -- reference plug-ins used by the registered plug-in jobs -------------------
def regex_analyzer(text: str) -> tuple[bool, str]:
    """Python-side pattern analyzer: e-mail first, then 3-3-4 phone."""
    import re

    from tracefold.functions.pii import PY_EMAIL_PATTERN, PY_PHONE_PATTERN
    if re.search(PY_EMAIL_PATTERN, text):
        return True, C.PII_EMAIL
    if re.search(PY_PHONE_PATTERN, text):
        return True, C.PII_PHONE
    return False, ""


def keyword_rails(phase: str, path: str, text: str) -> tuple[str, str, str | None, str]:
    """Keyword rail engine: jailbreak phrases block, the rest is allowed."""
    low = text.lower()
    for p in C.JAILBREAK_PHRASES:
        if p.lower() in low:
            return "block", C.JAILBREAK_RAIL, C.JAILBREAK_REFUSAL, ""
    return "allow", "on_topic", None, text


def overlap_judge(prompt: str, response: str) -> float:
    """Lexical grounding score: share of response words present in the prompt."""
    pw = set(prompt.lower().split())
    rw = response.lower().split()
    if not rw:
        return 0.0
    return sum(1 for w in rw if w in pw) / len(rw)
