"""Attribute gates for log records and spans (GT1, GT3-GT8).

Every gate is a per-row expression (``map_filter`` over the attribute map),
so a whole gate chain compiles to one codegen ``Project``/``Filter`` over the
scan: no join, no shuffle. The allowlist is a small fixed config, so it is
inlined as a literal ``CASE`` over the class instead of being joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold import constants as C


def effective_allowlist(extra: Mapping[str, Iterable[str]] | None = None,
                        base: Mapping[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    """Built-in allowlist per class with tenant extras unioned in.

    Extras for classes the base list does not know are ignored: tenants may
    only add fields to known classes.
    """
    base = C.CLASS_ALLOWLIST if base is None else base
    extra = extra or {}
    for cls in extra:
        if not cls:
            raise ValueError("extra allowlist has an empty class key")
    out = {}
    for cls, fields in base.items():
        merged = list(dict.fromkeys(list(fields) + list(extra.get(cls, ()))))
        out[cls] = sorted(merged)
    return out


def class_of(attrs: Column, class_attr: str = C.DEFAULT_CLASS_ATTRIBUTE) -> Column:
    """Record class: the string value of the class attribute, else ''."""
    v = attrs.getItem(class_attr)
    return F.coalesce(F.when(v["t"] == "str", v["s"]), F.lit(""))


def _allowed_keys(cls: Column, allow: Mapping[str, list[str]]) -> Column:
    """The class's field list as an array, null for an unknown class."""
    expr = None
    for name, fields in allow.items():
        arr = F.array(*[F.lit(f) for f in fields])
        expr = F.when(cls == name, arr) if expr is None else expr.when(cls == name, arr)
    return expr if expr is not None else F.lit(None).cast("array<string>")


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, however often they are used.

    A projection would be merged into those above it and a filter pushed below it, which copies a long expression (a packed
    attribute map) into every place that names it. The only element of an exploded array is out of reach of both.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    out = df.select("*", F.explode(F.array(row)).alias("__apart"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__apart")[n].alias(n) for n in columns])


def _classified(df: DataFrame, attrs: str, class_attr: str, allow: Mapping[str, list[str]]) -> DataFrame:
    """``df`` with ``__m`` (the attributes), ``__cls`` and ``__allow`` (the class's fields, null if it is unknown)."""
    out = _apart(df, __m=F.col(attrs))
    out = _apart(out, __cls=class_of(F.col("__m"), class_attr))
    return _apart(out, __allow=_allowed_keys(F.col("__cls"), allow))


def _oversized(v: Column, max_bytes: int) -> Column:
    if max_bytes <= 0:
        return F.lit(False)
    return (v["t"] == "str") & (F.octet_length(v["s"]) > max_bytes)


def guard_records(df: DataFrame, extra: Mapping[str, Iterable[str]] | None = None,
                  drop_unknown: bool = True, max_bytes: int = C.DEFAULT_MAX_FIELD_BYTES,
                  attrs: str = "attrs", class_attr: str = C.DEFAULT_CLASS_ATTRIBUTE,
                  with_counters: bool = False) -> DataFrame:
    """GT1/GT3/GT4/GT5 (+GT8 counters): per-class allowlist for log records.

    - known class: keep attributes on the class list (plus tenant extras);
      drop string values longer than ``max_bytes`` UTF-8 bytes (0 disables);
      drop the record if no attribute is left.
    - unknown or missing class: drop the record, or pass it through untouched
      when ``drop_unknown`` is False.
    With ``with_counters`` the output has ``known_class``, ``stripped`` and
    ``oversized`` columns for the batch totals.
    """
    if max_bytes < 0:
        raise ValueError("max_bytes must be >= 0")
    columns = df.columns
    out = _classified(df, attrs, class_attr, effective_allowlist(extra))
    m, allowed, known = F.col("__m"), F.col("__allow"), F.col("__allow").isNotNull()
    if with_counters:
        out = _apart(out, __kinds=_kinds(m, allowed, max_bytes))
        out = out.withColumn("known_class", known).withColumn("stripped", _count_kind(1)).withColumn("oversized", _count_kind(2))
    if drop_unknown:
        out = out.filter(known)
    kept = F.when(known, F.map_filter(m, lambda k, v: F.array_contains(allowed, k) & ~F.coalesce(_oversized(v, max_bytes), F.lit(False)))).otherwise(m)
    out = _apart(out, __kept=kept)
    # GT5: a known-class record left with no attributes is dropped.
    out = out.filter(~known | (F.size("__kept") > 0))
    more = ["known_class", "stripped", "oversized"] if with_counters else []
    return out.select(*[F.col("__kept").alias(c) if c == attrs else F.col(f"`{c}`") for c in columns], *more)


def _kinds(m: Column, allowed: Column, max_bytes: int) -> Column:
    """Per attribute: 0 kept, 1 stripped, 2 oversized; empty for an unknown class."""
    entries = F.filter(F.map_entries(m), lambda e: allowed.isNotNull())
    return F.transform(entries, lambda e: F.when(~F.array_contains(allowed, e["key"]), 1).when(_oversized(e["value"], max_bytes), 2).otherwise(0))


def _count_kind(kind: int) -> Column:
    return F.size(F.filter("__kinds", lambda k: k == kind))


def strip_counters(df: DataFrame, extra=None, max_bytes: int = C.DEFAULT_MAX_FIELD_BYTES,
                   attrs: str = "attrs", class_attr: str = C.DEFAULT_CLASS_ATTRIBUTE,
                   drop_unknown: bool = True) -> DataFrame:
    """GT8: batch totals of stripped / oversized attributes and drops per class.

    Counters are computed before any record is dropped so every input record
    is accounted for; the per-class totals are a map-side partial aggregate.
    """
    per = _classified(df, attrs, class_attr, effective_allowlist(extra))
    per = _apart(per, __kinds=_kinds(F.col("__m"), F.col("__allow"), max_bytes))
    dropped = F.when(F.col("__allow").isNull(), F.lit(drop_unknown)).otherwise(_count_kind(0) == 0)
    per = per.select(F.col("__cls").alias("event_class"), _count_kind(1).alias("stripped"), _count_kind(2).alias("oversized"), dropped.alias("dropped"))
    return per.groupBy("event_class").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum("stripped").cast("bigint").alias("n_stripped"),
        F.sum("oversized").cast("bigint").alias("n_oversized"),
        F.count_if(F.col("dropped")).alias("n_dropped"),
    )


def prefix_allowed(key: Column, prefixes: Iterable[str]) -> Column:
    prefixes = list(prefixes)
    for p in prefixes:
        if not p.endswith("."):
            raise ValueError(f"span prefix {p!r} must end with '.' to be namespace-scoped")
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | key.startswith(p)
    return cond


def _filter_prefix(m: Column, prefixes, max_bytes: int) -> Column:
    return F.map_filter(m, lambda k, v: prefix_allowed(k, prefixes) & ~_oversized(v, max_bytes))


def guard_spans(df: DataFrame, prefixes: Iterable[str] | None = None,
                max_bytes: int = C.DEFAULT_MAX_FIELD_BYTES, enabled: bool = True) -> DataFrame:
    """GT6/GT7: namespace-prefix allowlist on resource, span and event attributes.

    A span is dropped only when its own attributes and every event's attributes
    are empty after filtering; an emptied event stays on a kept span.
    Disabled (the collector default) means the input is returned unchanged.
    """
    if not enabled:
        return df
    prefixes = tuple(prefixes or C.default_span_prefixes())
    out = (df.withColumn("resource_attrs", _filter_prefix(F.col("resource_attrs"), prefixes, max_bytes))
             .withColumn("attrs", _filter_prefix(F.col("attrs"), prefixes, max_bytes))
             .withColumn("events", F.transform(
                 "events", lambda e: e.withField("attrs", _filter_prefix(e["attrs"], prefixes, max_bytes)))))
    event_attr_total = F.aggregate(F.col("events"), F.lit(0), lambda acc, e: acc + F.size(e["attrs"]))
    return out.filter((F.size("attrs") > 0) | (F.coalesce(event_attr_total, F.lit(0)) > 0))


def guard_typed(df: DataFrame, attr_cols: Iterable[str], extra: Mapping[str, Iterable[str]] | None = None,
                drop_unknown: bool = True, max_bytes: int = C.DEFAULT_MAX_FIELD_BYTES,
                class_col: str = "event_class", drop_empty: bool = True) -> DataFrame:
    """GT1/GT3-GT5 on a typed record frame: one column per attribute.

    A column not allowed for the row's class, or a string over ``max_bytes``
    bytes, becomes null (the attribute is absent). Columns not named in
    ``attr_cols`` (ids, timestamps) are carried unchanged. Without
    ``drop_empty``, records left without an attribute stay.

    The gate is simplified when the plan is built: a column every known class
    allows only keeps its size check; the empty-record filter is omitted when
    the class column itself is such an attribute and every class name fits
    the cap (a known-class record then always keeps its class). Small
    expressions keep the generated code small when later filters (sampler,
    policy) are pushed below the gate.
    """
    allow = effective_allowlist(extra)
    attr_cols = list(attr_cols)
    classes = list(allow)
    types = dict(df.dtypes)
    cls = F.coalesce(F.col(class_col), F.lit(""))
    known = cls.isin(classes)

    def size_ok(c: str) -> Column | None:
        if max_bytes > 0 and types[c] == "string":
            return F.coalesce(F.octet_length(F.col(c)) <= max_bytes, F.lit(True))
        return None

    cols, kept_flags = [], []
    for c in df.columns:
        if c not in attr_cols:
            cols.append(F.col(c))
            continue
        by = [k for k in classes if c in allow[k]]
        ok = size_ok(c)
        if len(by) == len(classes):
            expr = F.col(c) if ok is None else F.when(~known | ok, F.col(c))
            flag = F.col(c).isNotNull() if ok is None else (F.col(c).isNotNull() & ok)
        elif not by:
            expr = F.when(~known, F.col(c))
            flag = None
        else:
            cond = cls.isin(by) if ok is None else (cls.isin(by) & ok)
            expr = F.when(~known, F.col(c)).when(cond, F.col(c))
            flag = F.col(c).isNotNull() & cond
        cols.append(expr.alias(c))
        if flag is not None:
            kept_flags.append(flag)
    class_always_kept = (class_col in attr_cols and all(class_col in allow[k] for k in classes)
                         and (max_bytes <= 0 or all(len(k.encode()) <= max_bytes for k in classes)))
    if class_always_kept or not drop_empty:
        cond = known if drop_unknown else None
    else:
        left = F.lit(False)
        for f in kept_flags:
            left = left | f
        cond = (known & left) if drop_unknown else (~known | left)
    out = df if cond is None else df.filter(cond)
    return out.select(*cols)
