"""Trace search, summaries, trees and span-set conditions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.functions import records as R
from lumenspan.functions import spansets as S
from lumenspan.functions.filters import (
    attribute_filter,
    context_window,
    of_span,
    span_filter,
    time_window,
    window_bounds,
    within,
)
from lumenspan.operators import correlate, traces
from lumenspan.registry.base import (
    WITH_ALL,
    WITH_SPANS,
    all_of,
    joined,
    logs_of,
    query,
    rounded,
    spans_of,
)
from lumenspan.registry.services import WINDOW

_SUMMARY = """summaries AS (SELECT trace_id,
  arg_min(name, (parent_span_id <> '', start_time_unix_nano, span_id)) AS root_name,
  arg_min(service_name, (parent_span_id <> '', start_time_unix_nano, span_id)) AS root_service,
  min(start_time_unix_nano) AS start_time_unix_nano,
  max(end_time_unix_nano) - min(start_time_unix_nano) AS duration_nanos,
  count(*) AS span_count, count(*) FILTER (WHERE status_code = 2) AS error_count,
  array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services
  FROM {} GROUP BY trace_id)"""
_ALL_SUMMARIES = f"{WITH_SPANS}, {_SUMMARY.format('spans')}"


def _summary(df):
    return df.withColumn("services", joined("services"))


def _report(spark, sf_dir, condition):
    """Summaries of all traces that satisfy a condition."""
    return _summary(traces.matching_traces(spans_of(spark, sf_dir), condition))


def _having(*conditions: str) -> str:
    """SQL twin: traces for which each condition holds on some span."""
    parts = " AND ".join(f"trace_id IN (SELECT trace_id FROM spans WHERE {c})" for c in conditions)
    return f"{_ALL_SUMMARIES} SELECT * FROM summaries WHERE {parts}"


@query("trace_summaries", f"{_ALL_SUMMARIES} SELECT * FROM summaries")
def trace_summaries(spark, sf_dir):
    return _summary(traces.trace_summaries(spans_of(spark, sf_dir)))


_CANDIDATES = """candidates AS (SELECT trace_id, max(start_time_unix_nano) AS latest_start FROM spans
  WHERE service_name = 'RF' AND status_code = 2 AND duration_nanos >= 20000000
  GROUP BY trace_id ORDER BY latest_start DESC, trace_id LIMIT 50)"""
_RF = {"service": "RF", "errors_only": True, "min_duration": 20_000_000}


@query("candidate_traces", f"{WITH_SPANS}, {_CANDIDATES} SELECT * FROM candidates")
def candidate_traces(spark, sf_dir):
    return traces.candidate_traces(spans_of(spark, sf_dir), 50, **_RF)


@query("trace_ids", f"{WITH_SPANS}, {_CANDIDATES} SELECT trace_id FROM candidates")
def trace_ids(spark, sf_dir):
    return traces.trace_ids(spans_of(spark, sf_dir), 50, **_RF)


@query(
    "find_traces",
    f"{_ALL_SUMMARIES}, {_CANDIDATES} SELECT * FROM summaries WHERE trace_id IN (SELECT trace_id FROM candidates)",
)
def find_traces(spark, sf_dir):
    return _summary(traces.find_traces(spans_of(spark, sf_dir), 50, **_RF))


_SPAN_COLUMNS = [
    "trace_id", "span_id", "parent_span_id", "name", "service_name", "kind", "start_time_unix_nano",
    "end_time_unix_nano", "duration_nanos", "status_code", "status_message", "attributes", "resource_attributes",
]
_SPAN_LIST = ", ".join(_SPAN_COLUMNS)


@query("get_trace", f"{WITH_SPANS} SELECT {_SPAN_LIST} FROM spans WHERE trace_id = '7'")
def get_trace(spark, sf_dir):
    return traces.get_trace(spans_of(spark, sf_dir), "7").select(*_SPAN_COLUMNS)


_TREE = """RECURSIVE {spans},
nodes AS (SELECT trace_id, span_id, min(parent_span_id) AS parent_span_id, min(start_time_unix_nano) AS s
  FROM {source} GROUP BY trace_id, span_id),
walk AS (
  SELECT trace_id, span_id, 0 AS depth, [{{'s': s, 'id': span_id}}] AS path FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.trace_id = n.trace_id AND p.span_id = n.parent_span_id)
  UNION ALL
  SELECT n.trace_id, n.span_id, w.depth + 1, list_append(w.path, {{'s': n.s, 'id': n.span_id}})
  FROM walk w JOIN nodes n ON n.trace_id = w.trace_id AND n.parent_span_id = w.span_id),
bounds AS (SELECT trace_id, min(start_time_unix_nano) AS lo, max(end_time_unix_nano) AS hi FROM {source} GROUP BY trace_id)
SELECT x.trace_id, x.span_id, CAST(w.depth AS BIGINT) AS depth, x.start_time_unix_nano - b.lo AS offset_nanos,
  round(CAST(x.start_time_unix_nano - b.lo AS DOUBLE) / greatest(b.hi - b.lo, 1), 6) AS offset_share,
  round(CAST(x.duration_nanos AS DOUBLE) / greatest(b.hi - b.lo, 1), 6) AS width_share, w.position
FROM {source} x JOIN (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS position FROM walk) w USING (trace_id, span_id) JOIN bounds b USING (trace_id)"""


def _tree(spans):
    return traces.trace_tree(spans).select(
        "trace_id", "span_id", F.col("depth").cast("bigint").alias("depth"), "offset_nanos",
        rounded("offset_share"), rounded("width_share"), "position",
    )


_WITH = WITH_SPANS.removeprefix("WITH ")


@query("trace_tree", "WITH " + _TREE.format(spans=_WITH, source="spans"))
def trace_tree(spark, sf_dir):
    return _tree(spans_of(spark, sf_dir))


# Lines of an order as a call chain: line n is called by the first span of line n - 1, so trees get as
# deep as an order has lines, and a missing line number leaves orphans.
_CHAIN = """callers AS (SELECT trace_id, name, min(span_id) AS caller FROM spans WHERE parent_span_id <> '' GROUP BY ALL),
chain AS (SELECT s.* REPLACE (CASE WHEN s.parent_span_id = '' OR s.name = 'line 1' THEN s.parent_span_id
    ELSE coalesce(c.caller, 'lost') END AS parent_span_id)
  FROM spans s LEFT JOIN callers c ON c.trace_id = s.trace_id
    AND c.name = 'line ' || (TRY_CAST(regexp_extract(s.name, '[0-9]+$') AS INTEGER) - 1))"""


@query("trace_tree_chain", "WITH " + _TREE.format(spans=f"{_WITH}, {_CHAIN}", source="chain"))
def trace_tree_chain(spark, sf_dir):
    number = F.regexp_extract("name", "[0-9]+$", 0).try_cast("int")
    top = traces.is_root() | (F.col("name") == "line 1")

    def linked(spans, caller):
        return spans.withColumn("parent_span_id", F.when(top, F.col("parent_span_id")).otherwise(F.coalesce(caller, F.lit("lost"))))

    ordinary, large = traces.split_by_size(spans_of(spark, sf_dir))
    before = W.partitionBy("trace_id").orderBy(number).rangeBetween(-1, -1)
    called = ~traces.is_root() & (F.col("name") == F.concat(F.lit("line "), number.cast("string")))
    chain = linked(ordinary.withColumn("caller", F.min(F.when(called, F.col("span_id"))).over(before)), F.col("caller")).drop("caller")
    if large is not None:
        callers = large.filter(~traces.is_root()).groupBy("trace_id", F.col("name").alias("called_by")).agg(F.min("span_id").alias("caller"))
        spans = large.withColumn("called_by", F.concat(F.lit("line "), (number - 1).cast("string")))
        spans = linked(spans.join(callers, ["trace_id", "called_by"], "left"), F.col("caller"))
        chain = chain.unionByName(spans.select(*chain.columns))
    return _tree(chain)


_ERROR_COLUMNS = "trace_id, span_id, name, service_name, status_message, start_time_unix_nano, duration_nanos"


@query("error_spans", f"{WITH_SPANS} SELECT {_ERROR_COLUMNS} FROM spans WHERE status_code = 2")
def error_spans(spark, sf_dir):
    return traces.error_spans(spans_of(spark, sf_dir))


_COMPLETE = """SELECT trace_id, count(*) AS span_count,
  count(*) FILTER (WHERE parent_span_id <> '' AND NOT EXISTS (SELECT 1 FROM {0} p
    WHERE p.trace_id = x.trace_id AND p.span_id = x.parent_span_id)) AS orphan_count,
  count(*) FILTER (WHERE parent_span_id = '') = 0 AS root_missing FROM {0} x GROUP BY trace_id"""


@query("trace_completeness", f"{WITH_SPANS} {_COMPLETE.format('spans')}")
def trace_completeness(spark, sf_dir):
    return traces.trace_completeness(spans_of(spark, sf_dir))


_INSIDE = f"inside AS (SELECT * FROM spans WHERE start_time_unix_nano BETWEEN {WINDOW[0]} AND {WINDOW[1]})"


@query("trace_completeness_window", f"{WITH_SPANS}, {_INSIDE} {_COMPLETE.format('inside')}")
def trace_completeness_window(spark, sf_dir):
    return traces.trace_completeness(within(spans_of(spark, sf_dir), *WINDOW))


_IDS = ["1", "2", "3", "5", "8", "absent"]
_IDS_SQL = "('1', '2', '3', '5', '8', 'absent')"


@query(
    "investigate_status",
    f"""{_ALL_SUMMARIES} SELECT w.trace_id, s.trace_id IS NOT NULL AS found, coalesce(span_count, 0) AS span_count,
    coalesce(error_count, 0) AS error_count, coalesce(services, '') AS services
    FROM (SELECT unnest({_IDS!r}) AS trace_id) w LEFT JOIN summaries s USING (trace_id)""",
)
def investigate_status(spark, sf_dir):
    return traces.investigate(*all_of(spark, sf_dir), _IDS).status.withColumn("services", joined("services"))


@query("investigate_spans", f"{WITH_SPANS} SELECT {_SPAN_LIST} FROM spans WHERE trace_id IN {_IDS_SQL}")
def investigate_spans(spark, sf_dir):
    return traces.investigate(*all_of(spark, sf_dir), _IDS).spans.select(*_SPAN_COLUMNS)


_LOG_ORDER = "time_unix_nano DESC, trace_id, span_id, service_name, severity_number, body, attributes"


@query(
    "investigate_logs",
    f"""{WITH_ALL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY {_LOG_ORDER}) AS r FROM logs
    WHERE trace_id IN {_IDS_SQL}) SELECT trace_id, time_unix_nano, body, attributes FROM ranked WHERE r <= 20""",
)
def investigate_logs(spark, sf_dir):
    bundle = traces.investigate(*all_of(spark, sf_dir), _IDS, logs_per_trace=20)
    return bundle.logs.select("trace_id", "time_unix_nano", "body", "attributes")


@query(
    "investigate_exemplars",
    f"""{WITH_ALL} SELECT name AS metric_name, service_name, exemplar_trace AS trace_id, time_unix_nano, value
    FROM points WHERE exemplar_trace IN {_IDS_SQL}""",
)
def investigate_exemplars(spark, sf_dir):
    found = traces.investigate(*all_of(spark, sf_dir), _IDS).exemplars
    return found.select("metric_name", "service_name", "trace_id", "time_unix_nano", "value")


# ---- structured filters


@query(
    "window_filter",
    f"{WITH_SPANS} SELECT trace_id, span_id FROM spans WHERE start_time_unix_nano BETWEEN {WINDOW[0]} AND {WINDOW[1]}",
)
def window_filter(spark, sf_dir):
    start, end = (bound // 1_000_000 for bound in WINDOW)
    # The absolute start beats the lookback.
    kept = time_window(spans_of(spark, sf_dir), lookback=60, start_ms=start, end_ms=end)
    return kept.select("trace_id", "span_id")


@query(
    "lookback_filter",
    f"{WITH_SPANS} SELECT trace_id, span_id FROM spans WHERE start_time_unix_nano >= {WINDOW[1] - 30 * 86_400 * 10**9}",
)
def lookback_filter(spark, sf_dir):
    low, high = window_bounds(lookback=30 * 86_400, now_nanos=WINDOW[1])
    return within(spans_of(spark, sf_dir), low, high).select("trace_id", "span_id")


@query(
    "span_filters",
    f"""{WITH_SPANS} SELECT trace_id, span_id FROM spans WHERE service_name = 'RO' AND name = 'line 3'
    AND status_code = 2 AND duration_nanos BETWEEN 10000000 AND 40000000""",
)
def span_filters(spark, sf_dir):
    kept = span_filter("RO", "line 3", errors_only=True, min_duration=10_000_000, max_duration=40_000_000)
    return spans_of(spark, sf_dir).filter(kept).select("trace_id", "span_id")


@query(
    "attr_key_value",
    f"""{WITH_SPANS} SELECT trace_id, span_id FROM spans
    WHERE coalesce(json_extract_string(attributes, '$."http.status_code"') = '500', false)
      OR coalesce(json_extract_string(resource_attributes, '$."http.status_code"') = '500', false)""",
)
def attr_key_value(spark, sf_dir):
    kept = attribute_filter(" http.status_code = 500 ")
    return spans_of(spark, sf_dir).filter(kept).select("trace_id", "span_id")


@query(
    "attr_resource_value",
    f"""{WITH_SPANS} SELECT trace_id, span_id FROM spans
    WHERE json_extract_string(resource_attributes, '$."host.name"') = 'host-2'""",
)
def attr_resource_value(spark, sf_dir):
    return spans_of(spark, sf_dir).filter(attribute_filter("host.name=host-2")).select("trace_id", "span_id")


@query(
    "attr_substring",
    f"""{WITH_SPANS} SELECT trace_id, span_id FROM spans
    WHERE contains(attributes, '"number":7') OR contains(resource_attributes, '"number":7')""",
)
def attr_substring(spark, sf_dir):
    return spans_of(spark, sf_dir).filter(attribute_filter('"number":7')).select("trace_id", "span_id")


@query("logs_of_span", f"{WITH_ALL} SELECT time_unix_nano, body FROM logs WHERE trace_id = '7' AND span_id = '7'")
def logs_of_span(spark, sf_dir):
    kept = logs_of(spark, sf_dir).filter((F.col("trace_id") == "7") & of_span("7"))
    return kept.select("time_unix_nano", "body")


# 2024-01-10 12:00 UTC
MOMENT = 1_704_888_000_123_456_789


@query(
    "context_window",
    f"""{WITH_ALL} SELECT time_unix_nano, service_name, body FROM logs
    WHERE time_unix_nano BETWEEN ({MOMENT // 10**6} - 900000) * 1000000 AND ({MOMENT // 10**6} + 900000) * 1000000""",
)
def context_window_logs(spark, sf_dir):
    start, end = context_window(MOMENT)
    kept = time_window(logs_of(spark, sf_dir), start_ms=start, end_ms=end)
    return kept.select("time_unix_nano", "service_name", "body")


# ---- span sets


@query("spanset_scope", _having("json_extract_string(attributes, '$.line.number') = '7'"))
def spanset_scope(spark, sf_dir):
    return _report(spark, sf_dir, S.span_set(S.where("span.line.number", "=", 7)))


@query("spanset_resource", _having("json_extract_string(resource_attributes, '$.\"host.name\"') = 'host-1' AND kind = 'server'"))
def spanset_resource(spark, sf_dir):
    same = S.where("resource.host.name", "=", "host-1") & S.where("kind", "=", "server")
    return _report(spark, sf_dir, S.span_set(same))


@query("spanset_service", _having("service_name = 'RF' AND status_code = 2 AND duration_nanos > 45000000"))
def spanset_service(spark, sf_dir):
    same = S.where(".service.name", "=", "RF") & S.where("status", "=", "error") & S.where("duration", ">", 45_000_000)
    return _report(spark, sf_dir, S.span_set(same))


@query("spanset_missing", _having("coalesce(json_extract_string(attributes, '$.\"http.status_code\"') <> '200', false)"))
def spanset_missing(spark, sf_dir):
    return _report(spark, sf_dir, S.span_set(S.where(".http.status_code", "!=", 200)))


@query("spanset_not", _having("NOT coalesce(json_extract_string(attributes, '$.\"http.status_code\"') = '200', false) AND name <> 'line 1'"))
def spanset_not(spark, sf_dir):
    same = ~S.where(".http.status_code", "=", 200) & ~S.where("name", "=", "line 1")
    return _report(spark, sf_dir, S.span_set(same))


@query("spanset_flag", _having("json_extract_string(attributes, '$.returned') = 'true' AND name = 'line 5'"))
def spanset_flag(spark, sf_dir):
    return _report(spark, sf_dir, S.span_set(S.where("returned", ">=", 1) & S.where("name", "=", "line 5")))


@query("spanset_regex", _having("regexp_matches(name, '^line [67]') AND NOT regexp_matches(service_name, '^R')"))
def spanset_regex(spark, sf_dir):
    same = S.matches("name", "^line [67]") & S.matches(".service.name", "^R", negate=True)
    return _report(spark, sf_dir, S.span_set(same))


@query("spanset_exists", _having("contains(attributes, '\"discount\":') AND name = 'line 4'"))
def spanset_exists(spark, sf_dir):
    # A JSON null counts as present.
    return _report(spark, sf_dir, S.span_set(S.exists(".discount") & S.where("name", "=", "line 4")))


@query(
    "spanset_intrinsics",
    f"""{_ALL_SUMMARIES} SELECT * FROM summaries s WHERE root_name = 'order F' AND duration_nanos > 20000000000000000
    AND trace_id IN (SELECT trace_id FROM spans WHERE kind = 'client' AND duration_nanos < 5000000)""",
)
def spanset_intrinsics(spark, sf_dir):
    same = (
        S.where("rootName", "=", "order F")
        & S.where("traceDuration", ">", 20_000_000_000_000_000)
        & S.where("kind", "=", "client")
        & S.where("duration", "<", 5_000_000)
    )
    return _report(spark, sf_dir, S.span_set(same))


@query(
    "spanset_aggregate",
    f"""{_ALL_SUMMARIES} SELECT * FROM summaries WHERE trace_id IN (SELECT trace_id FROM spans WHERE status_code = 2
    AND parent_span_id <> '' GROUP BY trace_id HAVING count(*) > 1 AND avg(duration_nanos) > 30000000
    AND max(duration_nanos) <= 48000000)""",
)
def spanset_aggregate(spark, sf_dir):
    condition = S.span_set(
        S.where("status", "=", "error") & S.matches("name", "^line"),
        S.aggregate("count", None, ">", 1),
        S.aggregate("avg", "duration", ">", 30_000_000),
        S.aggregate("max", "duration", "<=", 48_000_000),
    )
    return _report(spark, sf_dir, condition)


@query(
    "spanset_attribute_aggregate",
    f"""{_ALL_SUMMARIES} SELECT * FROM summaries WHERE trace_id IN (SELECT trace_id FROM spans GROUP BY trace_id
    HAVING sum(CAST(json_extract_string(attributes, '$.line.number') AS DOUBLE)) >= 20
    AND min(CAST(json_extract_string(attributes, '$.line.number') AS DOUBLE)) = 2)""",
)
def spanset_attribute_aggregate(spark, sf_dir):
    condition = S.span_set(
        None, S.aggregate("sum", ".line.number", ">=", 20), S.aggregate("min", ".line.number", "=", 2)
    )
    return _report(spark, sf_dir, condition)


@query(
    "spanset_and_or",
    f"""{_ALL_SUMMARIES} SELECT * FROM summaries WHERE (trace_id IN (SELECT trace_id FROM spans WHERE name = 'line 1' AND status_code = 2)
    AND trace_id IN (SELECT trace_id FROM spans WHERE name = 'line 2' AND kind = 'client'))
    OR trace_id IN (SELECT trace_id FROM spans WHERE name = 'order F' AND duration_nanos > 400000000000)""",
)
def spanset_and_or(spark, sf_dir):
    first = S.span_set(S.where("name", "=", "line 1") & S.where("status", "=", 2))
    second = S.span_set(S.where("name", "=", "line 2") & S.where("kind", "=", "client"))
    third = S.span_set(S.where("name", "=", "order F") & S.where("duration", ">", 400_000_000_000))
    return _report(spark, sf_dir, first & second | third)


@query(
    "any_span",
    _having("contains(lower(name), 'line 6') AND contains(lower(concat_ws(' ', name, service_name, kind, attributes, resource_attributes)), 'host-3')"),
)
def any_span(spark, sf_dir):
    return _report(spark, sf_dir, S.any_span(R.spans.term("LINE 6", "operation") & R.spans.term("Host-3")))


@query(
    "search_traces",
    f"""{_ALL_SUMMARIES} SELECT * FROM summaries WHERE trace_id IN (SELECT trace_id FROM spans WHERE service_name = '1-URGENT')
    AND trace_id IN (SELECT trace_id FROM spans WHERE status_code = 2 AND json_extract_string(attributes, '$."http.method"') = 'GET'
      GROUP BY trace_id HAVING count(*) > 2) ORDER BY start_time_unix_nano DESC, trace_id LIMIT 20""",
)
def search_traces(spark, sf_dir):
    condition = S.span_set(
        S.where("status", "=", "error") & S.where(".http.method", "=", "GET"), S.aggregate("count", None, ">", 2)
    )
    return _summary(traces.search_traces(spans_of(spark, sf_dir), condition, service="1-URGENT"))


@query(
    "search_traces_many",
    f"""{_ALL_SUMMARIES} SELECT * FROM summaries WHERE trace_id IN (SELECT trace_id FROM spans WHERE status_code = 2)
    ORDER BY start_time_unix_nano DESC, trace_id LIMIT 1500""",
)
def search_traces_many(spark, sf_dir):
    return _summary(traces.search_traces(spans_of(spark, sf_dir), S.span_set(S.where("status", "=", "error")), 1500))


# ---- correlation


@query(
    "logs_of_traces",
    f"""{WITH_ALL} SELECT time_unix_nano, trace_id, service_name, body, attributes FROM logs
    WHERE trace_id IN (SELECT trace_id FROM spans WHERE status_code = 2 AND parent_span_id = '')""",
)
def logs_of_traces(spark, sf_dir):
    spans, logs, _ = all_of(spark, sf_dir)
    failed = spans.filter(traces.is_error() & traces.is_root())
    found = correlate.logs_of_traces(logs, failed)
    return found.select("time_unix_nano", "trace_id", "service_name", "body", "attributes")


@query(
    "traces_of_logs",
    f"""{WITH_ALL} SELECT l.time_unix_nano, l.trace_id, l.body, l.attributes, s.name AS span_name,
    s.service_name AS span_service, s.status_code AS span_status_code FROM logs l
    LEFT JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id AND l.span_id <> ''""",
)
def traces_of_logs(spark, sf_dir):
    spans, logs, _ = all_of(spark, sf_dir)
    return correlate.traces_of_logs(logs, spans).select(
        "time_unix_nano", "trace_id", "body", "attributes", "span_name", "span_service", "span_status_code"
    )


@query(
    "metrics_of_traces",
    f"""{WITH_ALL} SELECT name AS metric_name, service_name, exemplar_trace AS trace_id, time_unix_nano, value FROM points
    WHERE exemplar_trace IN (SELECT trace_id FROM spans WHERE status_code = 2)""",
)
def metrics_of_traces(spark, sf_dir):
    spans, _, points = all_of(spark, sf_dir)
    found = correlate.metrics_of_traces(points, spans.filter(traces.is_error()))
    return found.select("metric_name", "service_name", "trace_id", "time_unix_nano", "value")


_NEAR = f"BETWEEN ({MOMENT // 10**6} - 900000) * 1000000 AND ({MOMENT // 10**6} + 900000) * 1000000"


@query(
    "service_signals",
    f"""{WITH_ALL} SELECT 'logs' AS signal, count(*) AS n FROM logs WHERE service_name = 'svc-3' AND time_unix_nano {_NEAR}
    UNION ALL SELECT 'points', count(*) FROM points WHERE service_name = 'svc-3' AND time_unix_nano {_NEAR}
    UNION ALL SELECT 'spans', count(*) FROM spans WHERE service_name = 'svc-3' AND start_time_unix_nano {_NEAR}""",
)
def service_signals(spark, sf_dir):
    own = correlate.service_signals(all_of(spark, sf_dir), "svc-3", MOMENT)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("signal"), "n") for name, df in own._asdict().items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
