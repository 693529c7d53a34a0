"""Export documents, stored tables and streams, each compared with the tables they came from."""

from pyspark.sql import functions as F

from lumenspan.functions import records as R
from lumenspan.operators import metrics
from lumenspan.plans.checkpoints import work_dir
from lumenspan.registry.base import (
    LOGS_SQL,
    POINTS_SQL,
    WITH_LOGS,
    WITH_POINTS,
    WITH_SPANS,
    all_of,
    events_of,
    joined,
    logs_of,
    points_of,
    query,
    rounded,
    spans_of,
    with_sql,
)
from lumenspan.registry.metrics import _RATE, _steps
from lumenspan.session import settings
from lumenspan.sinks import otlp_export
from lumenspan.sinks.tables import append, append_all, sweep_expired
from lumenspan.sources import otlp_json, star_tables
from lumenspan.sources.tables import LOGS_DIR, POINTS_DIR, SPANS_DIR, Telemetry, read_table, read_tables, spans_from_table
from lumenspan.streaming import live

_SPAN_COLUMNS = [
    "trace_id", "span_id", "parent_span_id", "name", "service_name", "kind", "start_time_unix_nano",
    "end_time_unix_nano", "duration_nanos", "status_code", "status_message", "attributes", "resource_attributes",
]


@query("otlp_spans", f"{WITH_SPANS} SELECT {', '.join(_SPAN_COLUMNS)} FROM spans")
def otlp_spans(spark, sf_dir):
    documents = otlp_export.export_spans(spans_of(spark, sf_dir))
    typed = otlp_json.parse_documents(documents, otlp_json.SPAN_DOCUMENTS)
    return otlp_json.flatten_spans(typed).select(*_SPAN_COLUMNS)


_LOG_COLUMNS = ["time_unix_nano", "severity_number", "severity_text", "body", "body_json", "service_name", "trace_id", "span_id"]


@query(
    "otlp_logs",
    f"{WITH_LOGS} SELECT {', '.join(_LOG_COLUMNS)}, replace(attributes, ' ', '') AS attributes FROM logs",
)
def otlp_logs(spark, sf_dir):
    documents = otlp_export.export_logs(logs_of(spark, sf_dir))
    typed = otlp_json.parse_documents(documents, otlp_json.LOG_DOCUMENTS)
    return otlp_json.flatten_logs(typed).select(*_LOG_COLUMNS, "attributes")


_POINT_COLUMNS = ["name", "description", "unit", "metric_type", "service_name", "time_unix_nano", "value", "attributes"]


@query("otlp_points", f"{WITH_POINTS} SELECT {', '.join(_POINT_COLUMNS)} FROM points")
def otlp_points(spark, sf_dir):
    documents = otlp_export.export_metrics(points_of(spark, sf_dir))
    typed = otlp_json.parse_documents(documents, otlp_json.METRIC_DOCUMENTS)
    return otlp_json.flatten_metrics(typed).select(*_POINT_COLUMNS)


@query("points_as_docs", f"{WITH_POINTS} SELECT {', '.join(_POINT_COLUMNS)} FROM points WHERE name = 'signup'")
def points_as_docs(spark, sf_dir):
    documents = otlp_export.points_as_docs(points_of(spark, sf_dir), "signup")
    typed = otlp_json.parse_documents(documents, otlp_json.METRIC_DOCUMENTS)
    return otlp_json.flatten_metrics(typed).select(*_POINT_COLUMNS)


@query(
    "traces_as_docs",
    f"{WITH_SPANS} SELECT trace_id, span_id, name, status_code FROM spans WHERE trace_id IN ('3', '4', '11', '12')",
)
def traces_as_docs(spark, sf_dir):
    documents = otlp_export.traces_as_docs(spans_of(spark, sf_dir), ["3", "4", "11", "12", "absent"])
    typed = otlp_json.parse_documents(documents, otlp_json.SPAN_DOCUMENTS)
    return otlp_json.flatten_spans(typed).select("trace_id", "span_id", "name", "status_code")


_LEVELS = "repeat('{{\"n\":[', CAST(1 + {key} % 5 AS INT)) || {leaf} || repeat(']}}', CAST(1 + {key} % 5 AS INT))"
_DEEP = _LEVELS.format(key="o_orderkey", leaf="o_custkey")


@query(
    "otlp_deep_values",
    f"""SELECT o_orderkey + 1 AS time_unix_nano, {_DEEP} AS body_json, {_DEEP} AS body,
      '{{"deep":' || {_DEEP} || ',"half":' || o_custkey || '.5,"none":null,"text":"' || o_orderstatus || '{{["}}' AS attributes FROM orders""",
)
def otlp_deep_values(spark, sf_dir):
    """Log documents whose values have two to ten levels, flattened, exported and flattened again."""
    number = F.col("o_custkey").cast("string")
    opening = F.lit('{"kvlistValue":{"values":[{"key":"n","value":{"arrayValue":{"values":[')
    levels = (F.lit(1) + F.col("o_orderkey") % 5).cast("int")
    deep = F.concat(F.repeat(opening, levels), F.lit('{"intValue":"'), number, F.lit('"}'), F.repeat(F.lit("]}}}]}}"), levels))
    pair = lambda key, *value: F.concat(F.lit(f'{{"key":"{key}","value":'), *value, F.lit("}"))
    pairs = F.concat_ws(
        ",",
        pair("text", F.lit('{"stringValue":"'), F.col("o_orderstatus"), F.lit('{["}')),
        pair("none", F.lit("{}")),
        pair("half", F.lit('{"doubleValue":'), number, F.lit(".5}")),
        pair("deep", deep),
    )
    time = (F.col("o_orderkey") + 1).cast("string")
    record = F.concat(F.lit('{"timeUnixNano":"'), time, F.lit('","body":'), deep, F.lit(',"attributes":['), pairs, F.lit("]}"))
    text = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":['), record, F.lit("]}]}]}"))
    orders = star_tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # Rows of a few bytes become nested values: a file that is one task to read is work for many.
    documents = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select(text.alias("value"))
    read = lambda lines: otlp_json.flatten_logs(otlp_json.parse_documents(lines, otlp_json.LOG_DOCUMENTS))
    return read(otlp_export.export_logs(read(documents))).select("time_unix_nano", "body_json", "body", "attributes")


@query(
    "otlp_metric_types",
    """WITH o AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderkey % 2 = 0 AS even FROM orders)
    SELECT 'total' AS name, 'sum' AS metric_type, o_orderkey AS time_unix_nano, CAST(price AS DOUBLE) AS value, 0 AS count,
      '{"is_monotonic":' || even || ',"temporality":2}' AS extra, o_custkey || '/s' || o_orderkey || '/' || CAST(price AS DOUBLE) AS exemplars FROM o
    UNION ALL SELECT 'sizes', 'histogram', o_orderkey, CAST(price AS DOUBLE), 3,
      '{"bucket_counts":[1,2],"explicit_bounds":[' || CAST(o_custkey AS DOUBLE) || '],"max":2.5,"min":null,"temporality":1}', '' FROM o
    UNION ALL SELECT 'spread', 'exponential_histogram', o_orderkey, CAST(price AS DOUBLE), o_custkey,
      '{"max":null,"min":0.5,"scale":' || (o_orderkey % 5) || ',"zero_count":' || (o_orderkey % 3) || '}', '' FROM o
    UNION ALL SELECT 'latency', 'summary', o_orderkey, 0.0, 0,
      '{"quantiles":[{"quantile":0.5,"value":' || CAST(price AS DOUBLE) || '}]}', '' FROM o
    UNION ALL SELECT 'level', 'gauge', o_orderkey, CAST(price AS DOUBLE), 0, '{}', '' FROM o""",
)
def otlp_metric_types(spark, sf_dir):
    """One document per order with a point of every metric type; the sum has an exemplar of a span and one of none."""
    price, key = F.floor("o_totalprice").cast("bigint").cast("string"), F.col("o_orderkey").cast("string")
    customer = F.col("o_custkey").cast("string")
    time = ["\"timeUnixNano\":\"", key, "\""]
    exemplars = [
        ',"exemplars":[{"traceId":"', customer, '","spanId":"S', key, '","value":{"asInt":"', price, '"}},{"traceId":"","asDouble":1}]'
    ]
    metrics = [
        ['{"name":"total","sum":{"aggregationTemporality":2,"isMonotonic":', (F.col("o_orderkey") % 2 == 0).cast("string"),
         ',"dataPoints":[{', *time, ',"asInt":"', price, '"', *exemplars, "}]}}"],
        ['{"name":"sizes","histogram":{"aggregationTemporality":1,"dataPoints":[{', *time, ',"count":"3","sum":', price,
         ',"max":2.5,"bucketCounts":["1","2"],"explicitBounds":[', customer, "]}]}}"],
        ['{"name":"spread","exponentialHistogram":{"dataPoints":[{', *time, ',"count":"', customer, '","sum":', price, ',"min":0.5,"scale":',
         (F.col("o_orderkey") % 5).cast("string"), ',"zeroCount":"', (F.col("o_orderkey") % 3).cast("string"), '"}]}}'],
        ['{"name":"latency","summary":{"dataPoints":[{', *time, ',"quantileValues":[{"quantile":0.5,"value":', price, "}]}]}}"],
        ['{"name":"level","gauge":{"dataPoints":[{', *time, ',"asDouble":', price, "}]}}"],
    ]
    text = lambda parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    body = F.concat_ws(",", *map(text, metrics))
    documents = star_tables.table(spark, sf_dir, "orders").select(
        F.concat(F.lit('{"resourceMetrics":[{"scopeMetrics":[{"metrics":['), body, F.lit("]}]}]}")).alias("value")
    )
    points = otlp_json.flatten_metrics(otlp_json.parse_documents(documents, otlp_json.METRIC_DOCUMENTS))
    linked = F.transform("exemplars", lambda e: F.concat_ws("/", e["trace_id"], e["span_id"], e["value"].cast("string")))
    return points.select("name", "metric_type", "time_unix_nano", "value", "count", "extra", F.array_join(linked, " ").alias("exemplars"))


@query("export_roundtrip", f"{WITH_SPANS} SELECT trace_id, span_id, name, attributes FROM spans")
def export_roundtrip(spark, sf_dir):
    """Export documents written to files and read back."""
    path = work_dir(spark, "documents")
    otlp_export.write_documents(otlp_export.export_spans(spans_of(spark, sf_dir)), path)
    documents = otlp_json.read_documents(spark, path, otlp_json.SPAN_DOCUMENTS)
    return otlp_json.flatten_spans(documents.parsed).select("trace_id", "span_id", "name", "attributes")


# 2024-01-10 09:00 UTC: inside a date partition
_CUTOFF = 1_704_877_200_000_000_000


@query(
    "stored_and_swept",
    f"""{WITH_LOGS}, {POINTS_SQL.strip()} SELECT 'logs' AS signal, service_name, count(*) AS kept,
    (SELECT count(*) FROM logs WHERE time_unix_nano < {_CUTOFF}) AS swept FROM logs WHERE time_unix_nano >= {_CUTOFF} GROUP BY ALL
    UNION ALL SELECT 'metric_points', service_name, count(*),
    (SELECT count(*) FROM points WHERE time_unix_nano < {_CUTOFF}) FROM points WHERE time_unix_nano >= {_CUTOFF} GROUP BY ALL""",
)
def stored_and_swept(spark, sf_dir):
    """Tables appended to a new folder, swept, and read again."""
    path = work_dir(spark, "tables")
    tables = all_of(spark, sf_dir)
    # Order dates lie before the cutoff altogether; the span table starts empty.
    append_all(Telemetry(tables.spans.limit(0), tables.logs, tables.points), path)
    swept = sweep_expired(spark, path, _CUTOFF)
    stored = read_tables(spark, path)
    kept = [
        df.groupBy("service_name")
        .agg(F.count("*").alias("kept"))
        .select(F.lit(name).alias("signal"), "service_name", "kept", F.lit(n).cast("bigint").alias("swept"))
        for name, df, n in (("logs", stored.logs, swept.logs), ("metric_points", stored.points, swept.points))
    ]
    return kept[0].unionByName(kept[1])


# ---- streams over the table files


def _stream(spark, sf_dir, name):
    schema = star_tables.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _span_stream(spark, sf_dir):
    roots = star_tables.root_spans(_stream(spark, sf_dir, "orders"))
    return roots.unionByName(star_tables.child_spans(_stream(spark, sf_dir, "lineitem")))


def _collected(spark, stream, path, conf=None):
    """Run a stream over everything there is and return what it appended; in the same folder it goes on."""
    path = path if "/" in path else work_dir(spark, path)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
    )
    with settings(spark, conf or {}):
        started = writer.start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


_HOUR = 3_600 * 10**9
# A window is closed once it ends at or before the newest event (in whole milliseconds) less the delay.
_CLOSED = "closed AS (SELECT (max({t}) // 1000000) * 1000000 - {d} AS mark FROM {s})"


@query(
    "live_volume",
    f"""{WITH_LOGS}, {_CLOSED.format(t='time_unix_nano', d=_HOUR, s='logs')}
    SELECT CAST((time_unix_nano // {6 * _HOUR}) * {6 * _HOUR} AS BIGINT) AS time_unix_nano,
      count(*) FILTER (WHERE severity_number BETWEEN 1 AND 4) AS trace,
      count(*) FILTER (WHERE severity_number BETWEEN 5 AND 8) AS debug,
      count(*) FILTER (WHERE severity_number BETWEEN 9 AND 12 OR severity_number NOT BETWEEN 1 AND 24) AS info,
      count(*) FILTER (WHERE severity_number BETWEEN 13 AND 16) AS warn,
      count(*) FILTER (WHERE severity_number BETWEEN 17 AND 20) AS error,
      count(*) FILTER (WHERE severity_number BETWEEN 21 AND 24) AS fatal
    FROM logs, closed GROUP BY 1, mark HAVING (min(logs.time_unix_nano) // {6 * _HOUR} + 1) * {6 * _HOUR} <= mark""",
)
def live_volume(spark, sf_dir):
    stream = star_tables.event_logs(_stream(spark, sf_dir, "events"))
    return _collected(spark, live.live_volume(stream, "6 hours", "1 hour"), "live-volume")


_DAY = 24 * _HOUR


@query(
    "live_red",
    f"""{WITH_SPANS}, {_CLOSED.format(t='start_time_unix_nano', d=_DAY, s='spans')},
    windows AS (SELECT CAST((start_time_unix_nano // {10 * _DAY} - k) * {10 * _DAY} AS BIGINT) AS w, s.*
      FROM spans s, range(0, 3) r(k))
    SELECT w AS time_unix_nano, service_name, count(*) AS span_count,
      CAST(greatest(count(*) FILTER (WHERE kind = 'server' OR parent_span_id = ''), 1) AS BIGINT) AS request_count,
      count(*) FILTER (WHERE status_code = 2) AS error_count,
      round(CAST(count(*) FILTER (WHERE status_code = 2) AS DOUBLE) / count(*), 6) AS error_rate,
      {', '.join(f"round(list_sort(list(duration_nanos))[CAST(ceil({p} * count(*)) AS INTEGER)] / 1e6, 6) AS p{int(p * 100)}_ms" for p in (0.5, 0.95, 0.99))}
    FROM windows, closed WHERE w + {30 * _DAY} <= mark GROUP BY w, service_name""",
)
def live_red(spark, sf_dir):
    red = _collected(spark, live.live_red(_span_stream(spark, sf_dir), "30 days", "10 days", "1 day"), "live-red")
    figures = (rounded(c) for c in ("error_rate", "p50_ms", "p95_ms", "p99_ms"))
    return red.select("time_unix_nano", "service_name", "span_count", "request_count", "error_count", *figures)


_GAP = 241 * _HOUR


@query(
    "session_traces",
    f"""{WITH_SPANS}, {_CLOSED.format(t='start_time_unix_nano', d=_DAY, s='spans')},
    marked AS (SELECT *, CASE WHEN start_time_unix_nano - lag(start_time_unix_nano) OVER w < {_GAP} THEN 0 ELSE 1 END AS fresh
      FROM spans WINDOW w AS (PARTITION BY trace_id ORDER BY start_time_unix_nano)),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY start_time_unix_nano) AS session FROM marked)
    SELECT trace_id, arg_min(name, (parent_span_id <> '', start_time_unix_nano, span_id)) AS root_name,
      arg_min(service_name, (parent_span_id <> '', start_time_unix_nano, span_id)) AS root_service,
      min(start_time_unix_nano) AS start_time_unix_nano,
      max(end_time_unix_nano) - min(start_time_unix_nano) AS duration_nanos, count(*) AS span_count,
      count(*) FILTER (WHERE status_code = 2) AS error_count,
      array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services
    FROM numbered, closed GROUP BY trace_id, session, mark HAVING max(start_time_unix_nano) + {_GAP} <= mark""",
)
def session_traces(spark, sf_dir):
    closed = live.session_traces(_span_stream(spark, sf_dir), "241 hours", "1 day")
    return _collected(spark, closed, "sessions", live.SESSIONS_CONF).withColumn("services", joined("services"))


@query("dedup", f"{WITH_SPANS} SELECT trace_id, span_id, name FROM spans WHERE parent_span_id <> ''")
def dedup(spark, sf_dir):
    sent = star_tables.child_spans(_stream(spark, sf_dir, "lineitem"))
    again = star_tables.child_spans(_stream(spark, sf_dir, "lineitem"))
    unique = live.deduplicated(sent.unionByName(again)).select("trace_id", "span_id", "name")
    return _collected(spark, unique, "dedup")


@query("live_tail", f"{WITH_LOGS} SELECT time_unix_nano, service_name, attributes FROM logs WHERE level = 'error' AND scope_name = 'web'")
def live_tail(spark, sf_dir):
    logs = star_tables.event_logs(_stream(spark, sf_dir, "events"))
    wanted = R.logs.field_is("level", "error") & R.logs.field_is("scope", "w*b")
    return _collected(spark, live.live_tail(logs, wanted).select("time_unix_nano", "service_name", "attributes"), "tail")


_BY_NAME = "named AS (SELECT name || ' ' || service_name AS service_name, attributes, time_unix_nano, value FROM points)"


@query(
    "live_rate",
    f"""{with_sql(POINTS_SQL, _BY_NAME)}, {_steps('named', _RATE)}
    SELECT service_name, attributes, time_unix_nano, round(value, 9) AS value FROM stepped""",
)
def live_rate(spark, sf_dir):
    points = star_tables.event_points(_stream(spark, sf_dir, "events"))
    series = points.select(
        F.concat_ws(" ", "name", "service_name").alias("service_name"), "attributes", metrics.TIME, "value"
    )
    path = work_dir(spark, "live-rate")
    ends = live.Ending(spark, f"{path}/ends")
    rates = live.live_rate(ends.after(series), "1 hour")
    _collected(spark, rates, path)
    # All points are read; the end closes the times that still wait for later ones.
    ends.close()
    return _collected(spark, rates, path).withColumn("value", rounded("value", 9))


@query("live_ingest", f"{WITH_LOGS} SELECT {', '.join(_LOG_COLUMNS)} FROM logs")
def live_ingest(spark, sf_dir):
    """A stream of export documents flattened into the log table."""
    path = work_dir(spark, "ingest")
    otlp_export.write_documents(otlp_export.export_logs(logs_of(spark, sf_dir)), f"{path}/documents")
    documents = spark.readStream.schema(otlp_json.LOG_DOCUMENTS).json(f"{path}/documents")
    rows = otlp_json.flatten_logs(documents)
    live.start_ingest(rows, path, LOGS_DIR, f"{path}/checkpoint", availableNow=True).awaitTermination()
    return read_table(spark, path, LOGS_DIR).select(*_LOG_COLUMNS)


_EVENT_SPANS = """event_spans AS (SELECT 'svc-' || (user_id % 8) AS service_name, epoch_us(ts) * 1000 AS start_time_unix_nano,
  CAST(floor(greatest(value, 0)) AS BIGINT) * 1000 AS duration_nanos FROM events)"""


def _event_spans(events):
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    columns = {
        "trace_id": F.col("user_id").cast("string"),
        "span_id": F.col("event_id").cast("string"),
        "name": "event_type",
        "service_name": F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string")),
        "start_time_unix_nano": start,
        "end_time_unix_nano": start + F.floor(F.greatest("value", F.lit(0.0))).cast("bigint") * 1000,
    }
    return spans_from_table(events, columns)


def _shared_sql(signal: str, table: str, time: str, total: str) -> str:
    return f"""SELECT '{signal}' AS signal, service_name, count(*) AS kept, CAST({total} AS BIGINT) AS total,
      (SELECT count(*) FROM {table} WHERE {time} < {_CUTOFF}) AS swept FROM {table} WHERE {time} >= {_CUTOFF} GROUP BY ALL"""


@query(
    "shared_store",
    with_sql(_EVENT_SPANS, LOGS_SQL, POINTS_SQL)
    + " "
    + " UNION ALL ".join(
        [
            _shared_sql("spans", "event_spans", "start_time_unix_nano", "sum(duration_nanos)"),
            _shared_sql("logs", "logs", "time_unix_nano", "sum(severity_number)"),
            _shared_sql("metric_points", "points", "time_unix_nano", "count(value)"),
        ]
    ),
)
def shared_store(spark, sf_dir):
    """Spans, logs and points streamed into the tables that rows are appended to and swept from."""
    path = work_dir(spark, "shared")
    views = {SPANS_DIR: _event_spans, LOGS_DIR: star_tables.event_logs, POINTS_DIR: star_tables.event_points}
    live_half, other_half = F.col("user_id") % 2 == 0, F.coalesce(F.col("user_id") % 2 != 0, F.lit(True))
    for signal, view in views.items():
        rows = view(_stream(spark, sf_dir, "events").filter(live_half))
        live.start_ingest(rows, path, signal, f"{path}/checkpoints/{signal}", availableNow=True).awaitTermination()
        append(view(events_of(spark, sf_dir).filter(other_half)), path, signal)
    swept = sweep_expired(spark, path, _CUTOFF)
    sums = {SPANS_DIR: F.sum("duration_nanos"), LOGS_DIR: F.sum("severity_number"), POINTS_DIR: F.count("value")}
    parts = [
        table.groupBy("service_name")
        .agg(F.count("*").alias("kept"), sums[signal].cast("bigint").alias("total"))
        .select(F.lit(signal).alias("signal"), "service_name", "kept", "total", F.lit(n).cast("bigint").alias("swept"))
        for signal, table, n in zip(views, read_tables(spark, path), swept)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
