"""SQL fragments shared by the DuckDB oracle strings."""

from __future__ import annotations

from tracefold import constants as C
from tracefold.functions.hashing import hmac_pads, rate_threshold_hex
from tracefold.functions.pii import EMAIL_PATTERN_RE2, PHONE_PATTERN_RE2
from tracefold.operators.gates import effective_allowlist


def hmac_sql(msg_sql: str, key: bytes | str) -> str:
    ipad, opad = hmac_pads(key)
    return (f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({msg_sql}))))")


def keep_sql(rate: float, bucket_sql: str) -> str:
    if rate >= 1.0:
        return "TRUE"
    if rate <= 0.0:
        return "FALSE"
    return f"({bucket_sql} < '{rate_threshold_hex(rate)}')"


def sampler_keep_sql(cls: str, tenant: str, agent: str, key, rates: dict, default: float) -> str:
    msg = f"coalesce({tenant}, '') || '|' || coalesce({agent}, '') || '|' || coalesce({cls}, '')"
    bucket = f"substr({hmac_sql(msg, key)}, 1, 16)"
    whens = " ".join(f"WHEN coalesce({cls}, '') = '{c}' THEN {keep_sql(r, bucket)}" for c, r in rates.items())
    return f"(CASE {whens} ELSE {keep_sql(default, bucket)} END)"


def allowlist_values(extra=None) -> str:
    """``(VALUES (class, key), ...)`` of the effective allowlist."""
    rows = [f"('{c}', '{k}')" for c, ks in effective_allowlist(extra).items() for k in ks]
    return "(VALUES " + ", ".join(rows) + ") AS al(event_class, key)"


WS = C.PY_WHITESPACE_CLASS


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


def pii_cat_sql(x: str) -> str:
    return (f"(CASE WHEN regexp_matches({x}, '{EMAIL_PATTERN_RE2}') THEN '{C.PII_EMAIL}' "
            f"WHEN regexp_matches({x}, '{PHONE_PATTERN_RE2}') THEN '{C.PII_PHONE}' END)")


def placeholders_sql(x: str) -> str:
    e = f"regexp_replace({x}, '{EMAIL_PATTERN_RE2}', '<REDACTED:{C.PII_EMAIL}>', 'g')"
    return f"regexp_replace({e}, '{PHONE_PATTERN_RE2}', '\\1<REDACTED:{C.PII_PHONE}>\\2', 'g')"


def rails_sql(x: str) -> str:
    """Starter rail as SQL: struct-like columns via CASE (action, rail, response, modified)."""
    conds = " OR ".join(f"contains(lower({x}), '{p.lower()}')" for p in C.JAILBREAK_PHRASES)
    return conds
