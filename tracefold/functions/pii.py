"""PII detection as native regex column builders (FN9).

The default analyzer is the deterministic pattern analyzer: e-mail first,
then a 3-3-4 phone number; the first category that matches wins. Patterns are
written with explicit Unicode classes so Java regex (Spark) and RE2 (DuckDB)
agree with Python's ``re`` on non-ASCII text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold import constants as C

_WS = C.PY_WHITESPACE_CLASS
_WORD = "\\p{L}\\p{N}_"

# FIXED VALUES: pattern analyzer (category, pattern), in priority order.
# Written for RE2 (linear time) as the plain rule:
EMAIL_PATTERN_RE2 = f"[^{_WS}@]+@[^{_WS}@]+\\.[^{_WS}@]+"
# Java regex backtracks: a long run without '@' would cost O(n^2) per run.
# A leftmost match always starts at the start of a run of non-space,
# non-'@' characters, so anchoring there (look-behind) and never giving
# back the first run (possessive) finds the same matches in linear time.
EMAIL_PATTERN = f"(?<![^{_WS}@])[^{_WS}@]++@[^{_WS}@]+\\.[^{_WS}@]+"
# Whether there is a match at all: one character on either side decides, and a
# pattern that begins with its literal is left at once where that doesn't stand.
EMAIL_FOUND = f"@(?<=[^{_WS}@]@)[^{_WS}@]+\\.[^{_WS}@]"
# The left word boundary is a consumed group, not a look-behind: Java's
# look-behind sees only the low surrogate of an astral character (category
# Cs), so a letter such as U+252F3 before the digits would not count as a
# word character. Replacements put the group back with ``$1``.
PHONE_PATTERN = f"(^|[^{_WORD}])\\p{{Nd}}{{3}}-\\p{{Nd}}{{3}}-\\p{{Nd}}{{4}}(?![{_WORD}])"
# FIXED VALUES: the same two rules in Python ``re`` syntax (plug-in analyzer).
PY_EMAIL_PATTERN = r"[^\s@]+@[^\s@]+\.[^\s@]+"
PY_PHONE_PATTERN = r"\b\d{3}-\d{3}-\d{4}\b"
# What every phone number holds.
PHONE_SIGN = "-\\p{Nd}{3}-\\p{Nd}{4}"
# RE2 has no look-around; for detection the group form is equivalent.
PHONE_PATTERN_RE2 = f"(^|[^{_WORD}])\\p{{Nd}}{{3}}-\\p{{Nd}}{{3}}-\\p{{Nd}}{{4}}($|[^{_WORD}])"


# A literal every match of a rule must contain: texts without it skip the
# regex (a fast substring scan instead of a regex pass).
RULE_HINTS = {C.PII_EMAIL: "@", C.PII_PHONE: "-"}
# Patterns that are found in the same texts, only faster.
FOUND_BY = {EMAIL_PATTERN: EMAIL_FOUND}
# Replacement templates for rules whose pattern consumes a boundary group.
RULE_REPLACEMENTS = {C.PII_PHONE: "$1<REDACTED:" + C.PII_PHONE + ">"}


@dataclass(frozen=True)
class PatternAnalyzer:
    """Ordered (category, regex) rules; the first matching rule names the PII."""

    rules: tuple[tuple[str, str], ...] = ((C.PII_EMAIL, EMAIL_PATTERN), (C.PII_PHONE, PHONE_PATTERN))
    hints: tuple[tuple[str, str], ...] = tuple(RULE_HINTS.items())

    def _matches(self, text: Column, cat: str, pat: str) -> Column:
        hint = dict(self.hints).get(cat)
        m = text.rlike(FOUND_BY.get(pat, pat))
        return m if hint is None else (text.contains(hint) & m)

    def category(self, text: Column) -> Column:
        """Category of the first matching rule, null when none matches."""
        expr = None
        for cat, pat in self.rules:
            cond = self._matches(text, cat, pat)
            expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
        return expr if expr is not None else F.lit(None).cast("string")

    def categories(self, text: Column) -> Column:
        """All matching categories, in rule order (for entity roll-ups)."""
        arr = F.array(*[F.when(self._matches(text, c, p), F.lit(c)) for c, p in self.rules])
        return F.filter(arr, lambda x: x.isNotNull())

    def placeholders(self, text: Column) -> Column:
        """GT15: every match replaced by ``<REDACTED:CATEGORY>`` (rule order)."""
        out = text
        for cat, pat in self.rules:
            rep = F.regexp_replace(out, pat, RULE_REPLACEMENTS.get(cat, f"<REDACTED:{cat}>"))
            hint = dict(self.hints).get(cat)
            out = rep if hint is None else F.when(out.contains(hint), rep).otherwise(out)
        return out

    def count_matches(self, text: Column, category: str) -> Column:
        pat = dict(self.rules)[category]
        hint = dict(self.hints).get(category)
        n = F.regexp_count(text, F.lit(pat))
        return n if hint is None else F.when(text.contains(hint), n).otherwise(F.lit(0))


DEFAULT_ANALYZER = PatternAnalyzer()


def with_rules(extra: Sequence[tuple[str, str]]) -> PatternAnalyzer:
    """Default rules followed by user rules (lower priority, no hint)."""
    return PatternAnalyzer(DEFAULT_ANALYZER.rules + tuple(extra), DEFAULT_ANALYZER.hints)


# --------------------------------------------------------------------------- scored rules
@dataclass(frozen=True)
class ScoredRule:
    """A pattern that hints at a category: ``score`` where it matches, ``boost`` more where one of the ``context`` words stands
    in the text. With ``check`` a match counts for nothing unless its digits pass the check, and for 1.0 if they do.
    ``sign`` is a pattern that is quick to look for and found wherever the rule matches."""
    category: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    boost: float = 0.35
    check: str | None = None
    sign: str | None = None


CARD, NATIONAL_ID = "CREDIT_CARD", "US_SSN"
CARD_PATTERN, NATIONAL_ID_PATTERN = "(?:[0-9][ -]?){12,15}[0-9]", "(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9-])"
# Found in the same texts as the pattern, beginning with its literal.
FOUND_BY[NATIONAL_ID_PATTERN] = "-(?<=[0-9]{3}-)(?<![0-9-][0-9]{3}-)[0-9]{2}-[0-9]{4}(?![0-9-])"
SCORED_RULES = (
    ScoredRule(C.PII_EMAIL, EMAIL_PATTERN, 1.0),
    ScoredRule(CARD, CARD_PATTERN, 0.3, ("card", "visa"), check="luhn", sign="[0-9](?:[ -]?[0-9]){12}"),
    ScoredRule(NATIONAL_ID, NATIONAL_ID_PATTERN, 0.4, ("ssn", "social security")),
    ScoredRule(C.PII_PHONE, PHONE_PATTERN, 0.4, ("phone", "call ", "tel "), sign=PHONE_SIGN),
)


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits (blanks and hyphens are left out) passes the check-digit rule of card numbers."""
    d = F.reverse(F.regexp_replace(digits, "[ -]", ""))
    doubled = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return (F.length(d) > 0) & (total % 10 == 0)


@dataclass(frozen=True)
class ScoredAnalyzer:
    """FN9 with scores: the rule with the highest score names the category, if it reaches ``threshold``; of equal scores
    the earlier rule does. Native columns, one regex pass for each rule whose hint and sign stand in the text."""

    rules: tuple[ScoredRule, ...] = SCORED_RULES
    threshold: float = C.PII_SCORE_THRESHOLD

    def _score(self, text: Column, rule: ScoredRule) -> Column:
        if rule.check:
            found = F.exists(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), luhn_ok)
            found = found if rule.sign is None else text.rlike(rule.sign) & found
            return F.when(found, F.lit(1.0)).otherwise(F.lit(0.0))
        hint = RULE_HINTS.get(rule.category)
        match = text.rlike(FOUND_BY.get(rule.pattern, rule.pattern))
        match = match if rule.sign is None else text.rlike(rule.sign) & match
        match = match if hint is None else text.contains(hint) & match
        near = reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in rule.context], F.lit(False))
        full = min(1.0, round(rule.score + rule.boost, 6))
        return F.when(match, F.when(near, F.lit(full)).otherwise(F.lit(float(rule.score)))).otherwise(F.lit(0.0))

    def top(self, text: Column) -> Column:
        """``score, category`` of the best rule, null below the threshold; a null text has none.

        The text and the best rule are bound in lambdas, so that each rule is looked for once.
        """
        def best(t: Column) -> Column:
            return F.array_max(F.array(*[F.struct(self._score(t, r).alias("score"), F.lit(-i).alias("rank"), F.lit(r.category).alias("category"))
                                         for i, r in enumerate(self.rules)]))

        def once(value: Column, body) -> Column:
            return F.element_at(F.transform(F.array(value), body), 1)

        return once(text, lambda t: F.when(t.isNotNull(), once(best(t), lambda b: F.when(
            b["score"] >= self.threshold, F.struct(b["score"].alias("score"), b["category"].alias("category"))))))

    def category(self, text: Column) -> Column:
        return self.top(text)["category"]


def strip_whitespace(text: Column) -> Column:
    """Python ``str.strip()``: leading and trailing Unicode whitespace removed.

    ``btrim`` with the exact character set is codegen'd and only looks at the
    two ends of the string.
    """
    return F.btrim(text, F.lit(C.PY_WHITESPACE_CHARS))
