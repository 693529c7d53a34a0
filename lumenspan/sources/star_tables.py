"""Order, line item, event, document and conversation tables read as telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.jsontext import quote_json
from lumenspan.schema import EXEMPLAR
from lumenspan.sources.tables import Telemetry, logs_from_table, points_from_table, spans_from_table

MILLI = 1_000_000

# Severity number and text of each event type.
SEVERITIES = {
    "error": (17, "ERROR"),
    "signup": (13, "WARN"),
    "purchase": (9, "INFO"),
    "click": (5, "DEBUG"),
    "view": (1, "TRACE"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def json_object(entries: dict[str, Column]) -> Column:
    """JSON object text from JSON texts; keys are written in sorted order."""
    parts: list[Column] = []
    for position, key in enumerate(sorted(entries)):
        parts.append(F.lit(f'{"," if position else "{"}"{key}":'))
        parts.append(entries[key])
    return F.concat(*parts, F.lit("}"))


def _quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), column, F.lit('"'))


def root_spans(orders: DataFrame) -> DataFrame:
    status = F.col("o_orderstatus")
    start = nanos("o_orderdate")
    return spans_from_table(
        orders,
        {
            "trace_id": _text("o_orderkey"),
            "span_id": _text("o_orderkey"),
            "name": F.concat(F.lit("order "), status),
            "service_name": F.col("o_orderpriority"),
            "kind": F.lit("server"),
            "start_time_unix_nano": start,
            "end_time_unix_nano": start + F.floor("o_totalprice").cast("bigint") * MILLI,
            "status_code": F.when(status == "F", 2).when(status == "O", 1).otherwise(0),
            "status_message": F.when(status == "F", F.lit("order failed")).otherwise(F.lit("")),
            "attributes": json_object(
                {
                    "http.method": F.lit('"POST"'),
                    "http.status_code": F.when(status == "F", F.lit("500")).otherwise(F.lit("200")),
                    "order": json_object(
                        {"customer": _text("o_custkey"), "priority": _quoted(F.col("o_orderpriority"))}
                    ),
                }
            ),
            "resource_attributes": json_object(
                {
                    "host.name": _quoted(F.concat(F.lit("host-"), (F.col("o_custkey") % 4).cast("string"))),
                    "service.name": _quoted(F.col("o_orderpriority")),
                }
            ),
            "scope_name": F.lit("orders"),
        },
    )


def child_spans(lineitem: DataFrame) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    service = F.concat("l_returnflag", "l_linestatus")
    start = nanos("l_shipdate")
    quantity = F.col("l_quantity").cast("bigint")
    percent = F.round(F.col("l_discount") * 100).cast("bigint")
    return spans_from_table(
        lineitem,
        {
            "trace_id": _text("l_orderkey"),
            "span_id": F.concat(
                F.lit("l"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity)
            ),
            "parent_span_id": _text("l_orderkey"),
            "name": F.concat(F.lit("line "), _text("l_linenumber")),
            "service_name": service,
            "kind": F.when(F.col("l_linestatus") == "O", F.lit("client")).otherwise(F.lit("internal")),
            "start_time_unix_nano": start,
            "end_time_unix_nano": start + quantity * MILLI,
            "status_code": F.when(returned, 2).otherwise(0),
            "status_message": F.when(returned, F.lit("returned")).otherwise(F.lit("")),
            "attributes": json_object(
                {
                    "discount": F.when(percent == 0, F.lit("null")).otherwise(percent.cast("string")),
                    "http.method": F.lit('"GET"'),
                    "line": json_object({"number": _text("l_linenumber"), "part": _text("l_partkey")}),
                    "returned": F.when(returned, F.lit("true")).otherwise(F.lit("false")),
                }
            ),
            "resource_attributes": json_object(
                {
                    "host.name": _quoted(F.concat(F.lit("host-"), (F.col("l_suppkey") % 4).cast("string"))),
                    "service.name": _quoted(service),
                }
            ),
            "scope_name": F.lit("lines"),
        },
    )


def event_service() -> Column:
    return F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string"))


def event_logs(events: DataFrame) -> DataFrame:
    number, text = F.lit(0), F.lit("")
    for event_type, (severity, label) in SEVERITIES.items():
        number = F.when(F.col("event_type") == event_type, F.lit(severity)).otherwise(number)
        text = F.when(F.col("event_type") == event_type, F.lit(label)).otherwise(text)
    spoken = F.col("event_type").isin("error", "purchase")
    return logs_from_table(
        events,
        {
            "time_unix_nano": nanos("ts"),
            "observed_time_unix_nano": nanos("ts"),
            "severity_number": number,
            "severity_text": text,
            "body": "event_type",
            "body_json": _quoted(F.col("event_type")),
            "attributes": "props",
            "resource_attributes": json_object({"service.name": _quoted(event_service())}),
            "service_name": event_service(),
            "trace_id": _text("user_id"),
            "span_id": F.when(spoken, _text("user_id")).otherwise(F.lit("")),
            "scope_name": F.when(spoken, F.lit("web")).otherwise(F.lit("")),
        },
    )


def event_points(events: DataFrame) -> DataFrame:
    exemplar = F.struct(
        _text("user_id").alias("trace_id"),
        _text("user_id").alias("span_id"),
        nanos("ts").alias("time_unix_nano"),
        F.col("value").alias("value"),
    )
    none = F.array().cast(f"array<{EXEMPLAR.simpleString()}>")
    linked = F.col("event_type").isin("error", "purchase")
    return points_from_table(
        events,
        {
            "name": "event_type",
            "description": F.concat(F.lit("value of "), F.col("event_type")),
            "unit": F.lit("1"),
            "service_name": event_service(),
            "time_unix_nano": nanos("ts"),
            "value": "value",
            "attributes": json_object({"user": (F.col("user_id") % 4).cast("string")}),
            "resource_attributes": json_object({"service.name": _quoted(event_service())}),
            "exemplars": F.when(linked, F.array(exemplar)).otherwise(none),
        },
    )


def document_logs(documents: DataFrame) -> DataFrame:
    """Whole document texts as log bodies."""
    return logs_from_table(
        documents,
        {
            "time_unix_nano": F.col("doc_id") * MILLI,
            "severity_number": F.lit(9),
            "severity_text": F.lit("INFO"),
            "body": "text",
            "body_json": quote_json(F.col("text")),
            "attributes": json_object({"chars": _text("n_chars"), "lang": _quoted(F.col("lang"))}),
            "resource_attributes": json_object({"service.name": _quoted(F.col("source"))}),
            "service_name": "source",
            "trace_id": F.lit(""),
            "span_id": _text("doc_id"),
        },
    )


def conversation_logs(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation as the log records of one trace."""
    return logs_from_table(
        conversations,
        {
            "time_unix_nano": "turn",
            "severity_number": F.lit(9),
            "body": "text",
            "body_json": quote_json(F.col("text")),
            "service_name": "role",
            "trace_id": _text("conv_id"),
            "span_id": _text("turn"),
        },
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as root spans and their line items as children."""
    roots = root_spans(table(spark, sf_dir, "orders"))
    return roots.unionByName(child_spans(table(spark, sf_dir, "lineitem")))


def telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    events = table(spark, sf_dir, "events")
    return Telemetry(order_spans(spark, sf_dir), event_logs(events), event_points(events))
