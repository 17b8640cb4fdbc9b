"""Registered text jobs: redaction, rails, guardrail chain, hashes, PII (GT13-GT17, GT24, GT27, FN1-FN4, FN7, FN9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import constants as C
from tracefold.functions import hashing, labels
from tracefold.functions.pii import CARD, CARD_PATTERN, DEFAULT_ANALYZER, EMAIL_PATTERN_RE2, NATIONAL_ID, NATIONAL_ID_PATTERN, PHONE_PATTERN_RE2, ScoredAnalyzer
from tracefold.operators import contracts, rails, redaction
from tracefold.plans.oracle_views import with_views
from tracefold.plans.registry import register
from tracefold.plans.sqlfrag import hmac_sql, pii_cat_sql, placeholders_sql, rails_sql, strip_sql
from tracefold.schemas import pack_attrs
from tracefold.sources import tables as T

TENANT_KEY = b"tracefold-tenant-demo-key"
_RED_PATH = "decision_summary.text"


# --------------------------------------------------------------------------- GT13
@register("gt13_field_redaction", with_views("texts", extra=(("s", f"""
SELECT doc_id, value, {strip_sql('value')} AS stripped FROM texts"""), ("c", f"""
SELECT doc_id, value, stripped, {pii_cat_sql('stripped')} AS cat FROM s"""))) + f"""
SELECT doc_id,
       CASE WHEN cat IS NOT NULL THEN {hmac_sql('stripped', TENANT_KEY)} ELSE value END AS text_out,
       CAST(CASE WHEN cat IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_hashed,
       coalesce(cat, '') AS pii_categories
FROM c WHERE length(stripped) <= {C.REDACT_MAX_VALUE_CHARS}""")
def gt13_field_redaction(spark, sf_dir):
    """Texts as records: string attributes with PII replaced by the tenant-keyed hash."""
    t = T.texts(spark, sf_dir).withColumn("cls", F.lit("decision_summary"))
    rec = pack_attrs(t, {"event_class": ("cls", "str"), "text": ("value", "str"), "lang": ("lang", "str")})
    out = redaction.redact_records(rec, TENANT_KEY, skip=["lang"])
    return out.select("doc_id", F.col("attrs")["text"]["s"].alias("text_out"), "n_hashed",
                      F.array_join("pii_categories", ",").alias("pii_categories"))


# --------------------------------------------------------------------------- GT14
@register("gt14_redaction_contract", with_views("texts", extra=(("s", f"""
SELECT doc_id, path, {strip_sql('value')} AS stripped FROM texts"""),)) + f"""
SELECT doc_id, CAST(length(stripped) AS INTEGER) AS stripped_chars,
       length(stripped) <= {C.REDACT_MAX_VALUE_CHARS} AND length(path) BETWEEN 1 AND 256 AS valid
FROM s""")
def gt14_redaction_contract(spark, sf_dir):
    t = T.texts(spark, sf_dir)
    s = t.select("doc_id", "path", redaction.strip_whitespace(F.col("value")).alias("stripped"))
    return s.select("doc_id", F.char_length("stripped").alias("stripped_chars"),
                    redaction.request_valid(F.col("stripped"), F.col("path")).alias("valid"))


# --------------------------------------------------------------------------- GT15
@register("gt15_placeholder_redaction", with_views("texts") + f"""
SELECT doc_id, {placeholders_sql('value')} AS review_text FROM texts""")
def gt15_placeholder_redaction(spark, sf_dir):
    t = T.texts(spark, sf_dir)
    return t.select("doc_id", redaction.placeholder_redact(F.col("value")).alias("review_text"))


# --------------------------------------------------------------------------- GT16
def _chain_sql() -> str:
    return f"""
SELECT session_id, turn, phase,
       {rails_sql('content')} AS hit, content, cat FROM (
  SELECT session_id, turn, phase, cat,
         CASE WHEN cat IS NOT NULL THEN {hmac_sql('stripped', TENANT_KEY)} ELSE stripped END AS content
  FROM (SELECT session_id, turn, phase, stripped, {pii_cat_sql('stripped')} AS cat FROM (
        SELECT session_id, turn,
               CASE role WHEN 'user' THEN 'input' ELSE 'output_final' END AS phase,
               {strip_sql('text')} AS stripped
        FROM turns WHERE role IN ('user', 'assistant'))))"""


@register("gt16_guardrail_chain", with_views("turns", extra=(("g", _chain_sql()), ("v", """
SELECT *, (session_id + turn) % 19 <> 3 AS valid FROM g"""))) + f"""
SELECT session_id, turn, phase, valid, hit OR NOT valid AS blocked,
       CASE WHEN NOT valid THEN 'error' WHEN hit THEN 'block' ELSE 'allow' END AS action,
       CASE WHEN NOT valid THEN 'none' WHEN hit THEN '{C.JAILBREAK_RAIL}' ELSE 'passthrough' END AS rail,
       CASE WHEN NOT valid THEN NULL WHEN hit THEN '' ELSE content END AS content,
       CASE WHEN valid THEN coalesce(cat || ':1', '') ELSE '' END AS entities,
       CASE WHEN valid THEN concat_ws(',', 'pii:' || cat, CASE WHEN hit THEN 'rail:{C.JAILBREAK_RAIL}' END) ELSE '' END AS policies
FROM v""")
def gt16_guardrail_chain(spark, sf_dir):
    """Each user turn (input) and assistant turn (output) through redact -> rails; some come without a path."""
    t = T.turns(spark, sf_dir).filter(F.col("role").isin("user", "assistant"))
    t = t.withColumn("phase", F.when(F.col("role") == "user", "input").otherwise("output_final"))
    path = F.when((F.col("session_id") + F.col("turn")) % 19 == 3, "").otherwise(F.concat(F.lit("turn."), F.col("phase")))
    g = rails.guard_text(t, "text", path, TENANT_KEY)
    return g.select("session_id", "turn", "phase", F.col("guard.valid").alias("valid"), F.col("guard.blocked").alias("blocked"),
                    F.col("guard.action").alias("action"), F.col("guard.rail").alias("rail"),
                    F.col("guard.content").alias("content"),
                    F.array_join("guard.entities", ",").alias("entities"),
                    F.array_join("guard.policies", ",").alias("policies"))


# --------------------------------------------------------------------------- GT17
@register("gt17_rail_match", with_views("texts") + f"""
SELECT doc_id, NOT ({rails_sql('value')}) AS allowed,
       CASE WHEN {rails_sql('value')} THEN 'block' ELSE 'allow' END AS action,
       CASE WHEN {rails_sql('value')} THEN '{C.JAILBREAK_RAIL}' ELSE 'passthrough' END AS rail
FROM texts""")
def gt17_rail_match(spark, sf_dir):
    t = T.texts(spark, sf_dir)
    r = rails.check_rails(F.col("value"))
    return t.select("doc_id", r["allowed"].alias("allowed"), r["action"].alias("action"), r["rail"].alias("rail"))


# --------------------------------------------------------------------------- GT24
_POLICY_BY_LANG = {"en": "redacted", "fr": "hash-only", "de": "full"}


def _policy_col():
    expr = F.lit("hash-only")
    for lang, pol in _POLICY_BY_LANG.items():
        expr = F.when(F.col("lang") == lang, F.lit(pol)).otherwise(expr)
    return expr


@register("gt24_content_policy", with_views("texts", extra=(("p", """
SELECT doc_id, value, CASE lang WHEN 'en' THEN 'redacted' WHEN 'fr' THEN 'hash-only' WHEN 'de' THEN 'full'
       ELSE 'hash-only' END AS content_policy FROM texts"""),)) + f"""
SELECT doc_id, content_policy, sha256(value) AS content_hash,
       CASE content_policy WHEN 'full' THEN value WHEN 'redacted' THEN {placeholders_sql('value')} END AS content
FROM p""")
def gt24_content_policy(spark, sf_dir):
    t = T.texts(spark, sf_dir)
    out = contracts.content_record(t, "value", _policy_col())
    return out.select("doc_id", "content_policy", "content_hash", "content")


# --------------------------------------------------------------------------- GT27
@register("gt27_previews", with_views("turns") + f"""
SELECT session_id, turn, left(text, {C.PREVIEW_CHARS}) AS preview, CAST(length(text) AS INTEGER) AS n_chars FROM turns""")
def gt27_previews(spark, sf_dir):
    t = T.turns(spark, sf_dir)
    return t.select("session_id", "turn", *contracts.previews(F.col("text")))


# --------------------------------------------------------------------------- FN1-FN4
@register("fn1_sha256", with_views("texts") + "SELECT doc_id, sha256(value) AS content_hash FROM texts")
def fn1_sha256(spark, sf_dir):
    return T.texts(spark, sf_dir).select("doc_id", hashing.sha256_hex("value").alias("content_hash"))


@register("fn2_hmac_sha256", with_views("texts") + f"SELECT doc_id, {hmac_sql('value', TENANT_KEY)} AS keyed_hash FROM texts")
def fn2_hmac_sha256(spark, sf_dir):
    return T.texts(spark, sf_dir).select("doc_id", hashing.hmac_sha256_hex("value", TENANT_KEY).alias("keyed_hash"))


REKEY_KEYS = {f"t-{i}": f"tenant-key-{i}".encode() for i in range(4)}  # t-4 has no key


def _rekey_sql() -> str:
    whens = " ".join(f"WHEN tenant_id = '{t}' THEN {hmac_sql('query_hash', k)}" for t, k in REKEY_KEYS.items())
    return f"CASE {whens} END"


@register("fn3_rekeying", with_views("retrievals") + f"""
SELECT event_id, tenant_id, query_hash, {_rekey_sql()} AS tenant_hash FROM retrievals""")
def fn3_rekeying(spark, sf_dir):
    """Stored SHA-256 query hashes re-keyed per tenant: equal only within a tenant."""
    r = T.retrievals(spark, sf_dir).select("event_id", "tenant_id", "query_hash")
    return hashing.rekey_by_tenant(r, "query_hash", REKEY_KEYS, "tenant_hash")


@register("fn4_blake2b")
def fn4_blake2b(spark, sf_dir):
    """Probe prompt bodies hashed with BLAKE2b-128 (Arrow UDF; no native equivalent)."""
    a = T.attempts(spark, sf_dir)
    return a.select("attempt_id", hashing.blake2b_128_hex(F.col("prompt")).alias("prompt_hash_b2"))


# --------------------------------------------------------------------------- FN7 / FN9
def _count_sql(x: str, pat: str) -> str:
    return f"len(regexp_extract_all({x}, '{pat}'))"


@register("fn7_policy_labels", with_views("texts", extra=(("c", f"""
SELECT doc_id, {_count_sql('value', EMAIL_PATTERN_RE2)} AS n_email FROM texts"""),)) + f"""
SELECT doc_id, 'pii:{C.PII_EMAIL}' AS policy_id, '{C.PII_EMAIL}:' || CAST(n_email AS VARCHAR) AS entity
FROM c WHERE n_email > 0""")
def fn7_policy_labels(spark, sf_dir):
    """Per text: the policy id and ``category:count`` entity label of detected e-mails."""
    t = T.texts(spark, sf_dir)
    n = DEFAULT_ANALYZER.count_matches(F.col("value"), C.PII_EMAIL)
    c = t.select("doc_id", n.alias("n_email")).filter(F.col("n_email") > 0)
    return c.select("doc_id", labels.policy_ids("pii", F.array(F.lit(C.PII_EMAIL)))[0].alias("policy_id"),
                    labels.entity_label(F.lit(C.PII_EMAIL), F.col("n_email")).alias("entity"))


#: Endings that the stand-in texts get by their id: below the threshold, raised by context, check digits right and wrong, ties.
_HINTS = (" ref 415-555-0134", " phone 415-555-0134", " card 4111 1111 1111 1111", " card 4111 1111 1111 1112", " ssn 078-05-1120",
          " phone 415-555-0134 ssn 078-05-1120", " mail a@b.example card 4111-1111-1111-1111")
_HINTED = ("h", "SELECT doc_id, value || CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HINTS)) + " ELSE '' END AS t FROM texts")
_LUHN = """len(list_filter(list_transform(regexp_extract_all(t, '%s'), lambda m: reverse(regexp_replace(m, '[ -]', '', 'g'))), lambda r:
  list_sum(list_transform(range(1, length(r) + 1), lambda i: CASE WHEN i %% 2 = 1 THEN CAST(substr(r, i, 1) AS INTEGER)
    ELSE CAST(substr(r, i, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(r, i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) %% 10 = 0)) > 0""" % CARD_PATTERN


def _near(*words: str) -> str:
    return "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + ")"


@register("fn9_scored_pii", with_views("texts", extra=(_HINTED, ("s", f"""
SELECT doc_id, CASE WHEN regexp_matches(t, '{EMAIL_PATTERN_RE2}') THEN 1.0 ELSE 0.0 END AS email, CASE WHEN {_LUHN} THEN 1.0 ELSE 0.0 END AS card,
       CASE WHEN NOT regexp_matches(t, '{NATIONAL_ID_PATTERN}') THEN 0.0 WHEN {_near('ssn', 'social security')} THEN 0.75 ELSE 0.4 END AS ssn,
       CASE WHEN NOT regexp_matches(t, '{PHONE_PATTERN_RE2}') THEN 0.0 WHEN {_near('phone', 'call ', 'tel ')} THEN 0.75 ELSE 0.4 END AS phone
FROM h"""), ("g", "SELECT *, greatest(email, card, ssn, phone) AS best FROM s"))) + f"""
SELECT doc_id, CASE WHEN best >= {C.PII_SCORE_THRESHOLD} THEN CAST(best AS DOUBLE) END AS score,
       CASE WHEN best < {C.PII_SCORE_THRESHOLD} THEN NULL WHEN email = best THEN '{C.PII_EMAIL}' WHEN card = best THEN '{CARD}'
            WHEN ssn = best THEN '{NATIONAL_ID}' ELSE '{C.PII_PHONE}' END AS category FROM g""")
def fn9_scored_pii(spark, sf_dir):
    """The category with the highest score per text, if it reaches the threshold."""
    k = F.col("doc_id") % 8
    ending = F.coalesce(*[F.when(k == i, F.lit(h)) for i, h in enumerate(_HINTS)], F.lit(""))
    top = ScoredAnalyzer().top(F.concat("value", ending))
    return T.texts(spark, sf_dir).select("doc_id", top.alias("top")).select("doc_id", "top.score", "top.category")


@register("fn9_pii_regex", with_views("texts") + f"""
SELECT doc_id, {pii_cat_sql('value')} AS pii_category FROM texts WHERE {pii_cat_sql('value')} IS NOT NULL""")
def fn9_pii_regex(spark, sf_dir):
    t = T.texts(spark, sf_dir)
    return t.select("doc_id", DEFAULT_ANALYZER.category(F.col("value")).alias("pii_category")).filter(
        F.col("pii_category").isNotNull())
