"""Fail-closed predicates (GT9, UD4): a user's SQL boolean as columns that can't raise.

Spark parses and resolves the text; the resolved expression is then walked and built again from forms that yield null where
the original would raise (``try_add``, ``try_cast``, bounded access). An error must not turn into a plain null, which
``coalesce`` or ``IS NULL`` could take for an answer, so each part is built as a pair: its value, and whether it failed.
Failure spreads like an exception: through every operand that would have been evaluated, not through branches that
weren't (the right side of a decided AND or OR, an untaken CASE branch, a COALESCE argument behind the first
value). No session setting is touched, and implicit casts are covered as they are part of the resolved expression.

What is not known to be total (user functions, aggregates, window functions, subqueries, regular expressions that aren't
literals, anything not listed here) is refused: such a predicate keeps nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """The predicate holds something that may raise and has no total form."""


@dataclass(frozen=True)
class Part:
    """A subexpression: its value, and whether its evaluation failed (None: it can't)."""
    value: Column
    failed: Column | None = None


#: Functions without a failing input, by the class of their expression; they are called again by their SQL name.
TOTAL = frozenset("""
Upper Lower Length OctetLength BitLength StringTrim StringTrimLeft StringTrimRight Substring Left Right Concat ConcatWs
Contains StartsWith EndsWith StringInstr Reverse Size ArraySize ArrayContains MapKeys MapValues MapContainsKey ArrayMin ArrayMax
Greatest Least Floor Ceil Signum Sqrt Year Month DayOfMonth DayOfWeek DayOfYear Hour Minute Second Quarter WeekOfYear DateDiff
Md5 Sha1 Sha2 Crc32 XxHash64 Murmur3Hash IsNaN NaNvl Elt Levenshtein SoundEx
""".split())
STRICT: dict[str, Callable[..., Column]] = {
    "EqualTo": lambda a, b: a == b, "EqualNullSafe": lambda a, b: a.eqNullSafe(b), "LessThan": lambda a, b: a < b,
    "LessThanOrEqual": lambda a, b: a <= b, "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b,
    "Not": lambda a: ~a, "IsNull": lambda a: a.isNull(), "IsNotNull": lambda a: a.isNotNull(), "UnaryPositive": lambda a: a,
    "In": lambda a, *bs: reduce(lambda x, y: x | y, [a == b for b in bs], F.lit(False)),
}
TRY = {"Add": F.try_add, "Subtract": F.try_subtract, "Multiply": F.try_multiply, "Divide": F.try_divide, "Remainder": F.try_mod}


def _any(*failed: Column | None) -> Column | None:
    known = [f for f in failed if f is not None]
    return reduce(lambda a, b: a | b, known) if known else None


def _after(first: Column | None, go_on: Column, then: Column | None) -> Column | None:
    """Failure of something evaluated only where ``go_on`` holds, after ``first``."""
    return _any(first, go_on & then if then is not None else None)


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _own(value: Column, parts: list[Part]) -> Part:
    """A form that gives null exactly where the original fails or an operand is null."""
    whole = reduce(lambda a, b: a & b, [p.value.isNotNull() for p in parts])
    return Part(value, _any(*[p.failed for p in parts], whole & value.isNull()))


def _regex_ok(spark, pattern: str) -> bool:
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:                                       # py4j wraps PatternSyntaxException
        return False


class _Builder:
    def __init__(self, spark):
        self.spark = spark

    def literal_text(self, node) -> str:
        if node.getClass().getSimpleName() != "Literal" or node.value() is None:
            raise Refused(f"the pattern must be a literal: {node.sql()}")
        return node.value().toString()

    def build(self, node) -> Part:
        kind = node.getClass().getSimpleName()
        if kind == "Literal":
            return Part(F.expr(node.sql()))
        if kind == "AttributeReference":
            return Part(F.col("`" + node.name().replace("`", "``") + "`"))
        if kind in ("Alias", "KnownNullable"):
            return self.build(node.child())
        if kind == "GetStructField":
            child = self.build(node.child())
            return Part(child.value.getField(node.childSchema().apply(node.ordinal()).name()), child.failed)
        special = getattr(self, "on_" + kind.lower(), None)
        if special is not None:
            return special(node)
        if kind in STRICT or kind in TOTAL or kind in TRY:
            parts = [self.build(c) for c in _seq(node.children())]
            values = [p.value for p in parts]
            if kind in TRY:
                return _own(TRY[kind](*values), parts)
            value = STRICT[kind](*values) if kind in STRICT else F.call_function(node.prettyName(), *values)
            return Part(value, _any(*[p.failed for p in parts]))
        if "replacement" in {m.getName() for m in node.getClass().getMethods()}:        # Spark's own shorthand for other expressions
            return self.build(node.replacement())
        raise Refused(f"{kind} may fail: {node.sql()}")

    # evaluated from left to right, up to the one that decides
    def on_and(self, node) -> Part:
        a, b = self.build(node.left()), self.build(node.right())
        return Part(a.value & b.value, _after(a.failed, F.coalesce(a.value, F.lit(True)), b.failed))

    def on_or(self, node) -> Part:
        a, b = self.build(node.left()), self.build(node.right())
        return Part(a.value | b.value, _after(a.failed, ~F.coalesce(a.value, F.lit(False)), b.failed))

    def on_coalesce(self, node) -> Part:
        parts = [self.build(c) for c in _seq(node.children())]
        failed = None
        for p in reversed(parts):
            failed = _after(p.failed, p.value.isNull(), failed)
        return Part(F.coalesce(*[p.value for p in parts]), failed)

    def choice(self, branches: list[tuple[Part, Part]], otherwise: Part | None) -> Part:
        value, failed = otherwise.value if otherwise else F.lit(None), otherwise.failed if otherwise else None
        for cond, then in reversed(branches):
            taken = F.coalesce(cond.value, F.lit(False))
            inside = None
            if then.failed is not None or failed is not None:
                inside = F.when(taken, then.failed if then.failed is not None else F.lit(False)).otherwise(failed if failed is not None else F.lit(False))
            value, failed = F.when(taken, then.value).otherwise(value), _any(cond.failed, inside)
        return Part(value, failed)

    def on_if(self, node) -> Part:
        return self.choice([(self.build(node.predicate()), self.build(node.trueValue()))], self.build(node.falseValue()))

    def on_casewhen(self, node) -> Part:
        branches = [(self.build(b._1()), self.build(b._2())) for b in _seq(node.branches())]
        return self.choice(branches, self.build(node.elseValue().get()) if node.elseValue().isDefined() else None)

    def on_between(self, node) -> Part:
        x, low, high = self.build(node.input()), self.build(node.lower()), self.build(node.upper())
        return Part((x.value >= low.value) & (x.value <= high.value), _any(x.failed, low.failed, high.failed))

    # may fail by themselves
    def on_cast(self, node) -> Part:
        child = self.build(node.child())
        value = child.value.try_cast(node.dataType().sql())
        return Part(value, child.failed) if str(node.evalMode()) == "TRY" else _own(value, [child])

    def on_unaryminus(self, node) -> Part:
        child = self.build(node.child())
        return _own(F.try_subtract(F.lit(0).cast(node.dataType().sql()), child.value), [child])

    def on_abs(self, node) -> Part:
        child = self.build(node.child())
        return _own(F.when(child.value >= 0, child.value).otherwise(F.try_subtract(F.lit(0).cast(node.dataType().sql()), child.value)), [child])

    def on_integraldivide(self, node) -> Part:
        a, b = self.build(node.left()), self.build(node.right())
        low = F.lit(-(2 ** 63)).cast("bigint")
        bad = (b.value == 0) | ((a.value == low) & (b.value == -1))
        safe = F.when(~bad, F.call_function("div", a.value, F.when(bad, F.lit(1)).otherwise(b.value)))
        return _own(safe, [a, b])

    def on_pmod(self, node) -> Part:
        a, b = self.build(node.left()), self.build(node.right())
        return _own(F.when(b.value != 0, F.pmod(a.value, F.when(b.value == 0, F.lit(None)).otherwise(b.value))), [a, b])

    def on_getarrayitem(self, node) -> Part:
        array, at = self.build(node.child()), self.build(node.ordinal())
        outside = (at.value < 0) | (at.value >= F.size(array.value))
        return Part(F.get(array.value, at.value), _any(array.failed, at.failed, F.coalesce(outside, F.lit(False))))

    def on_getmapvalue(self, node) -> Part:
        m, key = self.build(node.child()), self.build(node.key())
        return Part(F.try_element_at(m.value, key.value), _any(m.failed, key.failed))

    def on_elementat(self, node) -> Part:
        held, at = self.build(node.left()), self.build(node.right())
        if node.left().dataType().getClass().getSimpleName().startswith("MapType"):
            return Part(F.try_element_at(held.value, at.value), _any(held.failed, at.failed))
        outside = (at.value == 0) | (F.abs(at.value.cast("bigint")) > F.size(held.value))
        value = F.when(at.value != 0, F.try_element_at(held.value, F.when(at.value == 0, F.lit(1)).otherwise(at.value)))
        return Part(value, _any(held.failed, at.failed, F.coalesce(outside, F.lit(False))))

    def on_like(self, node) -> Part:
        child, text = self.build(node.left()), self.literal_text(node.right())
        escape = str(node.escapeChar())
        if escape in text:
            raise Refused(f"an escape in a pattern may fail: {node.sql()}")
        return Part(child.value.like(text), child.failed)

    def on_rlike(self, node) -> Part:
        child, text = self.build(node.left()), self.literal_text(node.right())
        if not _regex_ok(self.spark, text):
            raise Refused(f"no regular expression: {text!r}")
        return Part(child.value.rlike(text), child.failed)

    def on_stringsplit(self, node) -> Part:
        text, pattern = self.build(node.str()), self.literal_text(node.regex())
        if not _regex_ok(self.spark, pattern):
            raise Refused(f"no regular expression: {pattern!r}")
        return Part(F.split(text.value, pattern), text.failed)

    def on_raiseerror(self, node) -> Part:
        return Part(F.lit(None).cast("void"), F.lit(True))


def fail_closed(df: DataFrame, predicate: str) -> Column:
    """A column over ``df``: true exactly where ``predicate`` evaluates to true without an error, else false.

    A predicate that isn't boolean, or that :class:`Refused` holds for, is false everywhere. One that doesn't parse or
    names a column that isn't there raises here, when the job is built.
    """
    analyzed = df.select(F.expr(predicate).alias("p"))._jdf.queryExecution().analyzed()
    node = analyzed.expressions().apply(0).child()
    if node.dataType().typeName() != "boolean":
        return F.lit(False)
    try:
        part = _Builder(df.sparkSession).build(node)
    except Refused:
        return F.lit(False)
    kept = F.coalesce(part.value.cast("boolean"), F.lit(False))
    return kept if part.failed is None else kept & ~F.coalesce(part.failed, F.lit(False))


def refusal(df: DataFrame, predicate: str) -> str | None:
    """Why a predicate is refused, for messages at configuration time; None if it isn't."""
    node = df.select(F.expr(predicate).alias("p"))._jdf.queryExecution().analyzed().expressions().apply(0).child()
    if node.dataType().typeName() != "boolean":
        return f"not a boolean: {node.sql()}"
    try:
        _Builder(df.sparkSession).build(node)
    except Refused as e:
        return str(e)
    return None
