"""OTLP/JSON trace and log intake (SC1, SC2).

Files are read with an explicit schema (never inferred) in PERMISSIVE mode
with a ``_corrupt_record`` column. Nested array/kvlist attribute values are
kept as JSON text. The nested ``resource -> scope -> span`` tree is flattened
with ``inline_outer``, so every level fans out inside one task: no shuffle.
Export files holding one request per line should be read with
``multi_line=False`` so large files split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.schemas import SPANS

ANY_VALUE = T.StructType([
    T.StructField("stringValue", T.StringType()),
    T.StructField("boolValue", T.BooleanType()),
    T.StructField("intValue", T.StringType()),      # int64 is a JSON string in OTLP/JSON
    T.StructField("doubleValue", T.DoubleType()),
    T.StructField("bytesValue", T.StringType()),
    T.StructField("arrayValue", T.StringType()),    # nested: raw JSON text
    T.StructField("kvlistValue", T.StringType()),
])
KEY_VALUES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()),
                                       T.StructField("value", ANY_VALUE)]))
RESOURCE = T.StructType([T.StructField("attributes", KEY_VALUES)])
SCOPE = T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])

OTLP_SPAN = T.StructType([
    T.StructField("traceId", T.StringType()),
    T.StructField("spanId", T.StringType()),
    T.StructField("parentSpanId", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("startTimeUnixNano", T.StringType()),
    T.StructField("endTimeUnixNano", T.StringType()),
    T.StructField("attributes", KEY_VALUES),
    T.StructField("events", T.ArrayType(T.StructType([
        T.StructField("timeUnixNano", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("attributes", KEY_VALUES)]))),
    T.StructField("status", T.StructType([T.StructField("code", T.IntegerType()),
                                          T.StructField("message", T.StringType())])),
])
OTLP_TRACES = T.StructType([
    T.StructField("resourceSpans", T.ArrayType(T.StructType([
        T.StructField("resource", RESOURCE),
        T.StructField("scopeSpans", T.ArrayType(T.StructType([
            T.StructField("scope", SCOPE),
            T.StructField("spans", T.ArrayType(OTLP_SPAN))])))]))),
    T.StructField("_corrupt_record", T.StringType()),
])

OTLP_LOG_RECORD = T.StructType([
    T.StructField("timeUnixNano", T.StringType()),
    T.StructField("observedTimeUnixNano", T.StringType()),
    T.StructField("severityNumber", T.IntegerType()),
    T.StructField("severityText", T.StringType()),
    T.StructField("body", ANY_VALUE),
    T.StructField("attributes", KEY_VALUES),
    T.StructField("traceId", T.StringType()),
    T.StructField("spanId", T.StringType()),
])
OTLP_LOGS = T.StructType([
    T.StructField("resourceLogs", T.ArrayType(T.StructType([
        T.StructField("resource", RESOURCE),
        T.StructField("scopeLogs", T.ArrayType(T.StructType([
            T.StructField("scope", SCOPE),
            T.StructField("logRecords", T.ArrayType(OTLP_LOG_RECORD))])))]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def any_value_to_attr(v: Column) -> Column:
    """OTLP AnyValue -> typed attribute value (unknown kinds -> null)."""
    t = (F.when(v["stringValue"].isNotNull(), F.lit("str"))
          .when(v["boolValue"].isNotNull(), F.lit("bool"))
          .when(v["intValue"].isNotNull(), F.lit("int"))
          .when(v["doubleValue"].isNotNull(), F.lit("double"))
          .when(v["arrayValue"].isNotNull() | v["kvlistValue"].isNotNull(), F.lit("json"))
          .when(v["bytesValue"].isNotNull(), F.lit("bytes")))
    return F.when(t.isNotNull(), F.struct(
        t.alias("t"), v["stringValue"].alias("s"), v["boolValue"].alias("b"),
        v["intValue"].try_cast("bigint").alias("i"),
        v["doubleValue"].alias("d"),
        F.coalesce(v["arrayValue"], v["kvlistValue"], v["bytesValue"]).alias("j")))


def kv_to_map(kvs: Column) -> Column:
    """OTLP key/value list -> attribute map (last duplicate key wins)."""
    return F.map_from_entries(F.transform(
        F.filter(F.coalesce(kvs, F.array().cast(KEY_VALUES)), lambda kv: any_value_to_attr(kv["value"]).isNotNull()),
        lambda kv: F.struct(kv["key"].alias("key"), any_value_to_attr(kv["value"]).alias("value"))))


def read_otlp(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("multiLine", multi_line).json(path))


def parse_otlp(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """Requests that travel as JSON text in a column (a bus, a table): the same columns as ``read_otlp``. A text that
    isn't JSON has only ``_corrupt_record`` set."""
    return df.select(F.from_json(col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def flatten_spans(raw: DataFrame) -> DataFrame:
    """SC1: nested trace batches -> one row per span (``schemas.SPANS``)."""
    r = raw.select(F.inline_outer("resourceSpans"))
    s = r.select(F.col("resource"), F.inline_outer("scopeSpans"))
    sp = s.select(F.col("resource"), F.col("scope"), F.inline_outer("spans")).filter(F.col("spanId").isNotNull())
    ev = F.transform(F.coalesce(F.col("events"), F.array().cast(OTLP_SPAN["events"].dataType)),
                     lambda e: F.struct(e["name"].alias("name"), e["timeUnixNano"].try_cast("bigint").alias("time_ns"),
                                        kv_to_map(e["attributes"]).alias("attrs")))
    out = sp.select(
        F.lower(F.col("traceId")).alias("trace_id"),
        F.lower(F.col("spanId")).alias("span_id"),
        F.when(F.col("parentSpanId") != "", F.lower(F.col("parentSpanId"))).alias("parent_span_id"),
        "name", "kind",
        F.col("startTimeUnixNano").try_cast("bigint").alias("start_ns"),
        F.col("endTimeUnixNano").try_cast("bigint").alias("end_ns"),
        F.col("status.code").alias("status_code"), F.col("status.message").alias("status_message"),
        F.col("scope.name").alias("scope_name"),
        kv_to_map(F.col("resource.attributes")).alias("resource_attrs"),
        kv_to_map(F.col("attributes")).alias("attrs"),
        ev.alias("events"),
    )
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SPANS.fields])


def flatten_records(raw: DataFrame, class_attr: str = "event_class", ns: str | None = None) -> DataFrame:
    """SC2: nested log batches -> one row per record, resource attributes
    carried down. Class, tenant, agent and time become top-level columns so
    filters on them push down to columnar storage once written."""
    r = raw.select(F.inline_outer("resourceLogs"))
    s = r.select(F.col("resource"), F.inline_outer("scopeLogs"))
    lr = s.select(F.col("resource"), F.col("scope"), F.inline_outer("logRecords")).filter(
        F.col("timeUnixNano").isNotNull() | F.col("attributes").isNotNull())
    attrs = kv_to_map(F.col("attributes"))
    tenant_key = f"{ns}.tenant_id" if ns else "tenant_id"
    agent_key = f"{ns}.agent_id" if ns else "agent_id"
    out = lr.select(
        F.col("timeUnixNano").try_cast("bigint").alias("time_ns"),
        F.col("severityText").alias("severity"),
        F.to_json(F.col("body")).alias("body_json"),
        F.lower(F.col("traceId")).alias("trace_id"), F.lower(F.col("spanId")).alias("span_id"),
        F.col("scope.name").alias("scope_name"),
        kv_to_map(F.col("resource.attributes")).alias("resource_attrs"),
        attrs.alias("attrs"))
    a = F.col("attrs")
    return out.select(
        "*",
        F.when(a[class_attr]["t"] == "str", a[class_attr]["s"]).alias("event_class"),
        F.when(a[tenant_key]["t"] == "str", a[tenant_key]["s"]).alias("tenant_id"),
        F.when(a[agent_key]["t"] == "str", a[agent_key]["s"]).alias("agent_id"),
        F.timestamp_micros(F.expr("(time_ns - pmod(time_ns, 1000)) div 1000")).cast("timestamp_ntz").alias("ts"))
