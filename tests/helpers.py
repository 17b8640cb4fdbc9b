"""Tiny fixture builders in the shapes of the collector's own tests."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.schemas import ATTR_MAP, ATTR_VALUE


def av(v):
    """Python value -> attribute value row."""
    if isinstance(v, bool):
        return ("bool", None, v, None, None, None)
    if isinstance(v, int):
        return ("int", None, None, v, None, None)
    if isinstance(v, float):
        return ("double", None, None, None, v, None)
    return ("str", v, None, None, None, None)


def records_df(spark, rows):
    """rows: list of dict attribute maps -> DataFrame(rid, attrs)."""
    data = [(i, {k: av(v) for k, v in r.items()}) for i, r in enumerate(rows)]
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("attrs", ATTR_MAP)])
    return spark.createDataFrame(data, schema)


def plain(attrs):
    """Attribute map row -> plain Python dict."""
    out = {}
    for k, v in (attrs or {}).items():
        t = v["t"]
        out[k] = {"str": v["s"], "bool": v["b"], "int": v["i"], "double": v["d"]}.get(t, v["j"])
    return out


__all__ = ["av", "records_df", "plain", "F", "ATTR_VALUE"]
