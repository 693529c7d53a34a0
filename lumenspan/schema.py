"""The three telemetry tables.

Times are epoch nanoseconds in BIGINT.  Unsigned 64-bit input above 2**63 wraps to a negative number.
Attribute maps are canonical JSON objects (sorted keys) in STRING columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("time_unix_nano", T.LongType()),
        T.StructField("attributes", T.StringType()),
    ]
)

LINK = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("attributes", T.StringType()),
    ]
)

EXEMPLAR = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("time_unix_nano", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

SPANS = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_span_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_time_unix_nano", T.LongType()),
        T.StructField("end_time_unix_nano", T.LongType()),
        T.StructField("duration_nanos", T.LongType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("status_message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("resource_attributes", T.StringType()),
        T.StructField("events", T.ArrayType(EVENT)),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("scope_name", T.StringType()),
        T.StructField("scope_version", T.StringType()),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("time_unix_nano", T.LongType()),
        T.StructField("observed_time_unix_nano", T.LongType()),
        T.StructField("severity_number", T.IntegerType()),
        T.StructField("severity_text", T.StringType()),
        # Text as shown to a reader, and the JSON text of the same value.
        T.StructField("body", T.StringType()),
        T.StructField("body_json", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("resource_attributes", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("scope_name", T.StringType()),
    ]
)

POINTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("metric_type", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("time_unix_nano", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("resource_attributes", T.StringType()),
        T.StructField("extra", T.StringType()),
        T.StructField("exemplars", T.ArrayType(EXEMPLAR)),
    ]
)

# Values stored for a column the source does not have.
DEFAULTS = {
    "attributes": "{}",
    "resource_attributes": "{}",
    "extra": "{}",
    "kind": "unspecified",
    "service_name": "unknown_service",
    "metric_type": "gauge",
    "body_json": "null",
    "body": "null",
}

SPAN_TIME = "start_time_unix_nano"
RECORD_TIME = "time_unix_nano"


def time_column(columns: list[str]) -> str:
    """Name of the column that carries the event time of a span, log or point table."""
    return SPAN_TIME if SPAN_TIME in columns else RECORD_TIME
