"""Explicit schemas and the typed attribute-value model.

An attribute map is ``MAP<STRING, STRUCT<t, s, b, i, d, j>>``: ``t`` names the
value kind (``str``, ``bool``, ``int``, ``double``, ``json`` for nested maps or
lists, ``bytes`` as base64 in ``j``) and exactly one of the other fields is set.
The discriminators a job filters on (event class, tenant, agent, time) are
also kept as top-level columns so predicates reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTR_VALUE = T.StructType([
    T.StructField("t", T.StringType()),
    T.StructField("s", T.StringType()),
    T.StructField("b", T.BooleanType()),
    T.StructField("i", T.LongType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("j", T.StringType()),
])
ATTR_MAP = T.MapType(T.StringType(), ATTR_VALUE)

SPAN_EVENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("time_ns", T.LongType()),
    T.StructField("attrs", ATTR_MAP),
])

SPANS = T.StructType([
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("parent_span_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("start_ns", T.LongType()),
    T.StructField("end_ns", T.LongType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("status_message", T.StringType()),
    T.StructField("scope_name", T.StringType()),
    T.StructField("resource_attrs", ATTR_MAP),
    T.StructField("attrs", ATTR_MAP),
    T.StructField("events", T.ArrayType(SPAN_EVENT)),
])

_KIND_FIELD = {"str": "s", "bool": "b", "int": "i", "double": "d", "json": "j"}


def attr_value(col: Column, kind: str) -> Column:
    """Wrap a column as a typed attribute value (null stays null)."""
    field = _KIND_FIELD[kind]
    casts = {"s": "string", "b": "boolean", "i": "bigint", "d": "double", "j": "string"}
    parts = []
    for name in ("t", "s", "b", "i", "d", "j"):
        if name == "t":
            parts.append(F.lit(kind).alias("t"))
        elif name == field:
            parts.append(col.cast(casts[name]).alias(name))
        else:
            parts.append(F.lit(None).cast(casts[name]).alias(name))
    return F.when(col.isNotNull(), F.struct(*parts))


def pack_attrs(df: DataFrame, spec: dict[str, tuple[str, str]], out: str = "attrs") -> DataFrame:
    """Build an attribute map from typed columns.

    ``spec`` maps attribute key -> (column name, kind). Null columns are left
    out of the map, as an unset attribute is absent rather than null. Built
    from ``flatten`` of one- or zero-element arrays, so no lambda runs.
    """
    entry_t = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", ATTR_VALUE)])
    parts = []
    for k, (c, kind) in spec.items():
        entry = F.struct(F.lit(k).alias("key"), attr_value(F.col(c), kind).alias("value"))
        parts.append(F.when(F.col(c).isNotNull(), F.array(entry)).otherwise(F.array().cast(T.ArrayType(entry_t))))
    return df.withColumn(out, F.map_from_entries(F.flatten(F.array(*parts))))


def attr_str(attrs: Column | str, key: str) -> Column:
    """String value of ``key`` or null when absent or not a string."""
    m = F.col(attrs) if isinstance(attrs, str) else attrs
    v = m.getItem(key)
    return F.when(v["t"] == "str", v["s"])


def attr_as_text(v: Column) -> Column:
    """Text rendering of any attribute value (for equality filters)."""
    return (F.when(v["t"] == "str", v["s"])
            .when(v["t"] == "bool", F.lower(v["b"].cast("string")))
            .when(v["t"] == "int", v["i"].cast("string"))
            .when(v["t"] == "double", v["d"].cast("string"))
            .otherwise(v["j"]))


def explode_attrs(df: DataFrame, id_cols: list[str], attrs: str = "attrs") -> DataFrame:
    """Row form ``(id..., key, vtype, vstr, vint, vdbl, vbool)`` of an attribute map."""
    return (df.select(*id_cols, F.explode(attrs).alias("key", "v"))
              .select(*id_cols, "key",
                      F.col("v.t").alias("vtype"), F.col("v.s").alias("vstr"),
                      F.col("v.i").alias("vint"), F.col("v.d").alias("vdbl"),
                      F.col("v.b").alias("vbool")))
