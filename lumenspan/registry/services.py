"""Service statistics, graph and table counters."""

from pyspark.sql import functions as F

from lumenspan.functions.filters import name_matches
from lumenspan.operators import services, traces
from lumenspan.registry.base import WITH_ALL, WITH_SPANS, all_of, query, rounded, spans_of

_DURATIONS = ["error_rate", "rate_per_sec", "p50_ms", "p95_ms", "p99_ms"]
_STATS = ["service_name", "span_count", "request_count", "error_count", *_DURATIONS]

# 1998-01-01 .. 1999-01-01
WINDOW = (883_612_800_000_000_000, 915_148_800_000_000_000)


def _ranked_sql(source: str) -> str:
    """Statistics over the rows of ``source``, ranked with a plain window."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY duration_nanos) - 1 AS i,
    count(*) OVER (PARTITION BY service_name) AS n FROM {source}),
covered AS (SELECT greatest(CAST(max(end_time_unix_nano) - min(start_time_unix_nano) AS DOUBLE) / 1e9, 1.0) AS s FROM {source}),
stats AS (SELECT service_name, count(*) AS span_count,
    greatest(count(*) FILTER (WHERE kind = 'server' OR parent_span_id = ''), 1) AS request_count,
    count(*) FILTER (WHERE status_code = 2) AS error_count,
    CAST(max(duration_nanos) FILTER (WHERE i = round((n - 1) * CAST(0.50 AS DOUBLE))) AS DOUBLE) / 1e6 AS p50_ms,
    CAST(max(duration_nanos) FILTER (WHERE i = round((n - 1) * CAST(0.95 AS DOUBLE))) AS DOUBLE) / 1e6 AS p95_ms,
    CAST(max(duration_nanos) FILTER (WHERE i = round((n - 1) * CAST(0.99 AS DOUBLE))) AS DOUBLE) / 1e6 AS p99_ms
  FROM ranked GROUP BY service_name)"""


def _stats_sql(source: str) -> str:
    return f"""{_ranked_sql(source)}
SELECT service_name, span_count, CAST(request_count AS BIGINT) AS request_count, error_count,
  round(CAST(error_count AS DOUBLE) / span_count, 6) AS error_rate,
  round(CAST(request_count AS DOUBLE) / s, 6) AS rate_per_sec,
  round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms
FROM stats, covered"""


def _report(stats):
    return stats.select(*_STATS[:4], *(rounded(name) for name in _DURATIONS))


@query("service_red", f"{WITH_SPANS}, {_stats_sql('spans')}")
def service_red(spark, sf_dir):
    return _report(services.service_stats(spans_of(spark, sf_dir)))


@query(
    "service_red_ranked",
    f"{WITH_SPANS}, {_stats_sql('spans')} ORDER BY CAST(error_count AS DOUBLE) / span_count DESC, p95_ms DESC, service_name LIMIT 5",
)
def service_red_ranked(spark, sf_dir):
    return _report(services.unhealthy_first(services.service_stats(spans_of(spark, sf_dir))).limit(5))


_IN_WINDOW = f"inside AS (SELECT * FROM spans WHERE start_time_unix_nano BETWEEN {WINDOW[0]} AND {WINDOW[1]})"


@query("service_red_window", f"{WITH_SPANS}, {_IN_WINDOW}, {_stats_sql('inside')}")
def service_red_window(spark, sf_dir):
    return _report(services.service_stats(spans_of(spark, sf_dir), *WINDOW))


_SAMPLE = """newest AS (SELECT trace_id FROM spans GROUP BY trace_id
  ORDER BY max(start_time_unix_nano) DESC, trace_id LIMIT 250),
chosen AS (SELECT * FROM spans WHERE trace_id IN (SELECT trace_id FROM newest))"""


@query("sampled_red", f"{WITH_SPANS}, {_SAMPLE}, {_stats_sql('chosen')}")
def sampled_red(spark, sf_dir):
    return _report(services.service_stats(spans_of(spark, sf_dir), sample_traces=250))


@query(
    "red_percentiles",
    f"""{WITH_SPANS}, {_ranked_sql('spans')}
    SELECT service_name, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms FROM stats""",
)
def red_percentiles(spark, sf_dir):
    ranks = services.latency_percentiles(spans_of(spark, sf_dir))
    return ranks.select("service_name", rounded("p50_ms"), rounded("p95_ms"), rounded("p99_ms"))


_NODES = """SELECT service_name, count(*) AS span_count, count(*) FILTER (WHERE status_code = 2) AS error_count,
  round(CAST(sum(duration_nanos) AS DOUBLE) / count(*) / 1e6, 6) AS avg_ms FROM spans GROUP BY service_name"""
_EDGES = """SELECT p.service_name AS source, c.service_name AS target, count(*) AS calls,
  count(*) FILTER (WHERE c.status_code = 2) AS errors,
  round(CAST(sum(c.duration_nanos) AS DOUBLE) / count(*) / 1e6, 6) AS avg_ms
FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id
WHERE c.parent_span_id <> '' AND c.service_name <> p.service_name {} GROUP BY ALL"""


@query("graph_nodes", f"{WITH_SPANS} {_NODES}")
def graph_nodes(spark, sf_dir):
    nodes = services.service_graph_nodes(spans_of(spark, sf_dir))
    return nodes.select("service_name", "span_count", "error_count", rounded("avg_ms"))


@query("graph_edges", f"{WITH_SPANS} {_EDGES.format('')}")
def graph_edges(spark, sf_dir):
    edges = services.service_graph_edges(spans_of(spark, sf_dir))
    return edges.select("source", "target", "calls", "errors", rounded("avg_ms"))


@query(
    "graph_filtered",
    f"{WITH_SPANS} {_EDGES.format('''AND contains(lower(p.service_name), 'o') AND contains(lower(c.service_name), 'o')''')}",
)
def graph_filtered(spark, sf_dir):
    spans = spans_of(spark, sf_dir)
    _, edges = services.filter_graph(services.service_graph_nodes(spans), services.service_graph_edges(spans), " O ")
    return edges.select("source", "target", "calls", "errors", rounded("avg_ms"))


@query(
    "services",
    f"{WITH_ALL} SELECT service_name FROM spans UNION SELECT service_name FROM logs UNION SELECT service_name FROM points",
)
def all_services(spark, sf_dir):
    return traces.list_services(*all_of(spark, sf_dir))


@query("operations", f"{WITH_SPANS} SELECT DISTINCT name FROM spans")
def operations(spark, sf_dir):
    return traces.list_operations(spans_of(spark, sf_dir))


@query("service_operations", f"{WITH_SPANS} SELECT DISTINCT name FROM spans WHERE service_name = 'RF'")
def service_operations(spark, sf_dir):
    return traces.list_operations(spans_of(spark, sf_dir), "RF")


@query(
    "storage_stats",
    f"""{WITH_ALL} SELECT (SELECT count(*) FROM spans) AS spans, (SELECT count(*) FROM logs) AS logs,
    (SELECT count(*) FROM points) AS metric_points, (SELECT count(*) FROM (SELECT service_name FROM spans
     UNION SELECT service_name FROM logs UNION SELECT service_name FROM points)) AS services""",
)
def storage_stats(spark, sf_dir):
    return services.storage_stats(*all_of(spark, sf_dir))


@query(
    "name_filter",
    f"{WITH_SPANS} SELECT service_name, count(*) AS span_count FROM spans WHERE contains(lower(service_name), 'me') GROUP BY 1",
)
def name_filter(spark, sf_dir):
    kept = spans_of(spark, sf_dir).filter(name_matches("service_name", " Me "))
    return kept.groupBy("service_name").agg(F.count("*").alias("span_count"))
