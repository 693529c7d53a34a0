"""Joins between traces, logs and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.functions.filters import context_window, time_window
from lumenspan.sources.tables import Telemetry


def newest_log_order() -> list[Column]:
    """Newest first; ties are settled by content so that a limit is repeatable."""
    ties = ("trace_id", "span_id", "service_name", "severity_number", "body", "attributes")
    return [F.desc("time_unix_nano"), *(F.col(name) for name in ties)]


def logs_of_traces(logs: DataFrame, traces: DataFrame, span_id: str | None = None, n: int | None = None) -> DataFrame:
    """Logs whose trace is among ``traces``, newest first; ``n`` limits the whole result."""
    if span_id:
        logs = logs.filter(F.col("span_id") == span_id)
    matched = logs.join(traces.select("trace_id"), "trace_id", "left_semi").select(*logs.columns)
    return matched if n is None else matched.orderBy(*newest_log_order()).limit(n)


#: Shares into which the logs of a trace are split to be ranked.
SHARES = 64


def newest_per_trace(logs: DataFrame, n: int) -> DataFrame:
    """Newest n logs of each trace.

    A trace with very many logs is ranked in shares first, also before the shuffle, so that at most n logs of each
    share meet.
    """
    share = F.pmod(F.xxhash64("time_unix_nano", "span_id", "body", "attributes"), F.lit(SHARES))
    near = F.row_number().over(W.partitionBy("trace_id", "__share").orderBy(*newest_log_order()))
    split = logs.withColumn("__share", share).withColumn("__near", near).filter(F.col("__near") <= n)
    rank = F.row_number().over(W.partitionBy("trace_id").orderBy(*newest_log_order()))
    return split.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__share", "__near", "__rank")


def traces_of_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each log with the span it belongs to, where one was received."""
    linked = logs.filter((F.col("trace_id") != "") & (F.col("span_id") != ""))
    # Only spans that a log names are grouped.
    named = spans.join(linked.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"], "left_semi")
    first = F.min(F.struct("start_time_unix_nano", "name", "service_name", "duration_nanos", "status_code"))
    owners = named.groupBy("trace_id", "span_id").agg(first.alias("span"))
    loose = logs.filter((F.col("trace_id") == "") | (F.col("span_id") == ""))
    joined = linked.join(owners, ["trace_id", "span_id"], "left").select(*logs.columns, "span")
    # Logs without ids cannot match; they skip the join instead of meeting on one empty key.
    rest = loose.withColumn("span", F.lit(None).cast(joined.schema["span"].dataType))
    return joined.unionByName(rest).select(
        *logs.columns,
        F.col("span.name").alias("span_name"),
        F.col("span.service_name").alias("span_service"),
        F.col("span.duration_nanos").alias("span_duration_nanos"),
        F.col("span.status_code").alias("span_status_code"),
    )


def exemplar_rows(points: DataFrame) -> DataFrame:
    """One row per exemplar with the metric it was taken from."""
    rows = points.select("name", "service_name", "metric_type", "unit", F.explode("exemplars").alias("e"))
    return rows.select(
        F.col("name").alias("metric_name"), "service_name", "metric_type", "unit",
        "e.trace_id", "e.span_id", "e.time_unix_nano", "e.value",
    )


def metrics_of_traces(points: DataFrame, traces: DataFrame) -> DataFrame:
    """Exemplars that name one of the traces, ids compared without case."""
    wanted = traces.select(F.lower("trace_id").alias("__id")).distinct()
    rows = exemplar_rows(points).withColumn("__id", F.lower("trace_id"))
    return rows.join(wanted, "__id", "left_semi").drop("__id")


def service_signals(tables: Telemetry, service: str, moment_nanos: int | None = None) -> Telemetry:
    """Spans, logs and points of one service, optionally around a moment."""
    own = [df.filter(F.col("service_name") == service) for df in tables]
    if moment_nanos is not None:
        start, end = context_window(moment_nanos)
        own = [time_window(df, start_ms=start, end_ms=end) for df in own]
    return Telemetry(*own)
