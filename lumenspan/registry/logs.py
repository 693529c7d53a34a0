"""Log search, record predicates, histogram, fields and retention."""

from pyspark.sql import functions as F

from lumenspan.functions import records as R
from lumenspan.functions.filters import log_filter
from lumenspan.operators import fields, logs
from lumenspan.operators.correlate import logs_of_traces
from lumenspan.registry.base import (
    WITH_ALL,
    WITH_DOCS,
    WITH_LOGS,
    WITH_SPANS,
    all_of,
    docs_of,
    events_of,
    logs_of,
    query,
    spans_of,
)
from lumenspan.sinks.tables import expired_counts, keep_newest
from lumenspan.sources import star_tables

_COLUMNS = ["time_unix_nano", "severity_number", "service_name", "body", "attributes"]
_LIST = ", ".join(_COLUMNS)
_ORDER = "time_unix_nano DESC, trace_id, span_id, service_name, severity_number, body, attributes"

# 2024-01-10 00:00 .. 2024-01-20 00:00 UTC
WINDOW = (1_704_844_800_000_000_000, 1_705_708_800_000_000_000)


def _matching(spark, sf_dir, predicate):
    return logs_of(spark, sf_dir).filter(predicate).select(*_COLUMNS)


@query(
    "log_filters",
    f"""{WITH_LOGS} SELECT {_LIST} FROM logs WHERE service_name = 'svc-2' AND severity_number >= 13
    AND time_unix_nano BETWEEN {WINDOW[0]} AND {WINDOW[1]}""",
)
def log_filters(spark, sf_dir):
    kept = log_filter(service="svc-2", min_severity=13, trace_id="", time_min=WINDOW[0], time_max=WINDOW[1])
    return _matching(spark, sf_dir, kept)


@query("log_trace_filter", f"{WITH_LOGS} SELECT {_LIST} FROM logs WHERE trace_id = '5'")
def log_trace_filter(spark, sf_dir):
    return _matching(spark, sf_dir, log_filter(trace_id="5", min_severity=0))


@query(
    "log_text",
    f"""{WITH_LOGS} SELECT {_LIST} FROM logs WHERE contains(lower(body_json), '"err') OR contains(lower(attributes), '"err')
    OR contains(lower(severity_text), '"err')""",
)
def log_text(spark, sf_dir):
    return _matching(spark, sf_dir, log_filter(search='"ERR'))


@query("query_logs", f"{WITH_LOGS} SELECT {_LIST} FROM logs WHERE severity_number >= 17 ORDER BY {_ORDER} LIMIT 300")
def query_logs(spark, sf_dir):
    return logs.query_logs(logs_of(spark, sf_dir), 300, min_severity=17).select(*_COLUMNS)


# ---- field predicates


@query("log_eq", f"{WITH_LOGS} SELECT {_LIST} FROM logs WHERE level = 'error' OR lower(severity_text) = 'warn'")
def log_eq(spark, sf_dir):
    return _matching(spark, sf_dir, R.logs.field_is("Level", "ERROR") | R.logs.field_is("severity", "Warn"))


@query("log_glob", f"{WITH_LOGS} SELECT {_LIST} FROM logs WHERE body LIKE 'p%ch%e' OR service_name LIKE '%-7'")
def log_glob(spark, sf_dir):
    return _matching(spark, sf_dir, R.logs.field_is("body", "P*ch*e") | R.logs.field_is("service.name", "*-7"))


@query(
    "log_cmp",
    f"{WITH_LOGS} SELECT {_LIST} FROM logs WHERE CAST(json_extract_string(attributes, '$.k') AS DOUBLE) >= 90 AND severity_number < 17",
)
def log_cmp(spark, sf_dir):
    return _matching(spark, sf_dir, R.logs.field_cmp("k", ">=", 90) & R.logs.field_cmp("severity_number", "<", 17))


@query(
    "log_bare",
    f"""{WITH_LOGS} SELECT {_LIST} FROM logs
    WHERE contains(lower(concat_ws(' ', body, attributes, resource_attributes, severity_text, service_name)), ': 42')
      OR lower(concat_ws(' ', body, attributes, resource_attributes, severity_text, service_name)) LIKE '%click%svc-1%'""",
)
def log_bare(spark, sf_dir):
    return _matching(spark, sf_dir, R.logs.has_text(": 42") | R.logs.has_text("CLICK*svc-1"))


@query(
    "log_bool",
    f"""{WITH_LOGS} SELECT {_LIST} FROM logs WHERE (body = 'view' OR body = 'click')
    AND NOT (CAST(json_extract_string(attributes, '$.k') AS DOUBLE) > 50)""",
)
def log_bool(spark, sf_dir):
    wanted = R.logs.field_is("body", "view") | R.logs.field_is("message", "click")
    return _matching(spark, sf_dir, wanted & ~R.logs.field_cmp("k", ">", 50))


@query("log_not_missing", f"{WITH_LOGS} SELECT {_LIST} FROM logs WHERE body = 'signup'")
def log_not_missing(spark, sf_dir):
    return _matching(spark, sf_dir, ~R.logs.field_is("no.such.field", "*") & R.logs.field_is("body", "signup"))


@query(
    "span_nested_field",
    f"{WITH_SPANS} SELECT trace_id, span_id FROM spans WHERE json_extract_string(attributes, '$.order.priority') LIKE '_-high'"
    " OR lower(json_extract_string(attributes, '$.order.priority')) LIKE '%-high'",
)
def span_nested_field(spark, sf_dir):
    return spans_of(spark, sf_dir).filter(R.spans.field_is("order.priority", "*-HIGH")).select("trace_id", "span_id")


# ---- text predicates over whole documents


def _documents(spark, sf_dir, predicate):
    return docs_of(spark, sf_dir).filter(predicate).select("doc_id", "service_name")


def _doc_sql(condition: str) -> str:
    return f"{WITH_DOCS} SELECT doc_id, service_name FROM docs WHERE {condition}"


_RECORD = "lower(concat_ws(' ', body, attributes, resource_attributes, 'INFO', service_name))"
_TOKENS = """list_transform(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> ''),
  lambda x: trim(x, '",{{}}[]:'))"""


@query("term", _doc_sql("contains(lower(body), 'tion of')"))
def term(spark, sf_dir):
    return _documents(spark, sf_dir, R.logs.term("Tion Of", "body"))


@query("term_record", _doc_sql(f"contains({_RECORD}, '\"lang\":\"de\"')"))
def term_record(spark, sf_dir):
    return _documents(spark, sf_dir, R.logs.term('"LANG":"de"'))


@query("wildcard", _doc_sql("service_name LIKE 'src1_' OR json_extract_string(attributes, '$.lang') LIKE 'e%'"))
def wildcard(spark, sf_dir):
    return _documents(spark, sf_dir, R.logs.term("SRC1?", "service") | R.logs.term("e*", "lang"))


@query(
    "fuzzy",
    _doc_sql("""len(list_filter(regexp_split_to_array(lower(body), '\\s+'),
    lambda w: w <> '' AND levenshtein(regexp_replace(w, '[^\\x00-\\x7F]', '~', 'g'), 'ethering') <= 2)) > 0"""),
)
def fuzzy(spark, sf_dir):
    return _documents(spark, sf_dir, R.logs.fuzzy("Ethering", 2, "body"))


def _phrase_sql(column: str, first: str, second: str, slop: int) -> str:
    tokens = _TOKENS.format(column)
    return f"""{WITH_DOCS}, tokens AS (SELECT doc_id, service_name, {tokens} AS t FROM docs)
    SELECT doc_id, service_name FROM tokens WHERE len(list_filter(range(1, len(t) + 1), lambda i:
      contains(t[i], '{first}') AND len(list_filter(t[i + 1:i + 1 + {slop}], lambda x: contains(x, '{second}'))) > 0)) > 0"""


@query("phrase", _phrase_sql("body", "the", "with", 0))
def phrase(spark, sf_dir):
    return _documents(spark, sf_dir, R.logs.phrase("THE with", 0, "body"))


@query("proximity", _phrase_sql("body", "idiot", "the", 4))
def proximity(spark, sf_dir):
    return _documents(spark, sf_dir, R.logs.phrase(["idiot", "the"], 4, "body"))


@query("proximity_wide", _phrase_sql("body", "idiot", "clown", 90))
def proximity_wide(spark, sf_dir):
    return _documents(spark, sf_dir, R.logs.phrase(["idiot", "clown"], 90, "body"))


@query(
    "between",
    _doc_sql("""(CAST(json_extract_string(attributes, '$.chars') AS BIGINT) >= 400
    AND CAST(json_extract_string(attributes, '$.chars') AS BIGINT) < 900) AND service_name > 'src1' AND service_name <= 'src5'"""),
)
def between(spark, sf_dir):
    size = R.logs.between(400, 900, include_high=False, field="chars")
    return _documents(spark, sf_dir, size & R.logs.between("src1", "src5", include_low=False, field="service"))


@query(
    "bool_occur",
    _doc_sql("""json_extract_string(attributes, '$.lang') IN ('en', 'fr') AND NOT contains(lower(body), 'http')
    AND CAST(json_extract_string(attributes, '$.chars') AS BIGINT) >= 1000"""),
)
def bool_occur(spark, sf_dir):
    either = R.logs.bool_of(should=[R.logs.term("en", "lang"), R.logs.term("fr", "lang")])
    wanted = R.logs.bool_of(
        must=[either, R.logs.between(1000, field="chars")],
        should=[R.logs.term("never required")],
        must_not=[R.logs.term("http", "body")],
    )
    return _documents(spark, sf_dir, wanted)


@query(
    "search_logs",
    f"""{WITH_LOGS} SELECT {_LIST} FROM logs WHERE service_name = 'svc-4' AND NOT body = 'view'
    AND CAST(json_extract_string(attributes, '$.k') AS DOUBLE) BETWEEN 10 AND 60 ORDER BY {_ORDER} LIMIT 200""",
)
def search_logs(spark, sf_dir):
    wanted = ~R.logs.field_is("body", "view") & R.logs.between(10, 60, field="k")
    return logs.search_logs(logs_of(spark, sf_dir), wanted, service="svc-4").select(*_COLUMNS)


@query(
    "thread_logs",
    """SELECT turn AS time_unix_nano, role AS service_name, CAST(conv_id AS VARCHAR) AS trace_id, length(text) AS characters
    FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user' AND contains(lower(text), 'the '))""",
)
def thread_logs(spark, sf_dir):
    turns = star_tables.conversation_logs(star_tables.table(spark, sf_dir, "conversations"))
    asked = turns.filter(R.logs.field_is("service", "user") & R.logs.term("The ", "body")).select("trace_id").distinct()
    found = logs_of_traces(turns, asked)
    size = F.length("body").cast("bigint").alias("characters")
    return found.select("time_unix_nano", "service_name", "trace_id", size)


@query("search_logs_many", f"{WITH_LOGS} SELECT {_LIST} FROM logs WHERE body <> 'view' ORDER BY {_ORDER} LIMIT 6000")
def search_logs_many(spark, sf_dir):
    return logs.search_logs(logs_of(spark, sf_dir), ~R.logs.field_is("body", "view"), 6000).select(*_COLUMNS)


# ---- histogram


def _histogram_sql(condition: str, buckets: int, low: str = "min(time_unix_nano)", high: str = "max(time_unix_nano)") -> str:
    counts = ", ".join(
        f"count(l.time_unix_nano) FILTER (WHERE l.severity_number BETWEEN {a} AND {b}) AS {name}"
        for name, (a, b) in logs.HISTOGRAM_LEVELS.items()
    )
    return f"""{WITH_LOGS}, kept AS (SELECT * FROM logs WHERE {condition}),
ends AS (SELECT {low} AS lo, greatest({high}, {low} + 1) AS hi, greatest((greatest({high}, {low} + 1) - {low}) // {buckets}, 1) AS width FROM kept),
slots AS (SELECT i, lo + i * width AS t FROM ends, range(0, {buckets}) r(i)),
placed AS (SELECT k.*, least((time_unix_nano - lo) // width, {buckets} - 1) AS i FROM kept k, ends),
histogram AS (SELECT CAST(s.t AS BIGINT) AS time_unix_nano, {counts},
  count(l.time_unix_nano) FILTER (WHERE l.severity_number NOT BETWEEN 1 AND 8 AND l.severity_number NOT BETWEEN 13 AND 24) AS info
  FROM slots s LEFT JOIN placed l USING (i) GROUP BY s.t)"""


@query("log_histogram", _histogram_sql("service_name <> 'svc-0' OR true", 60) + " SELECT * FROM histogram")
def log_histogram(spark, sf_dir):
    return logs.log_histogram(logs_of(spark, sf_dir), 60)


_FIXED = _histogram_sql(
    f"time_unix_nano BETWEEN {WINDOW[0]} AND {WINDOW[1]} AND body <> 'view'",
    500,
    f"CAST({WINDOW[0]} AS BIGINT)",
    f"CAST({WINDOW[1]} AS BIGINT)",
)


@query("log_histogram_window", _FIXED.replace("FROM kept),", "FROM (SELECT 1)),") + " SELECT * FROM histogram")
def log_histogram_window(spark, sf_dir):
    return logs.log_histogram(
        logs_of(spark, sf_dir), 500, ~R.logs.field_is("body", "view"), time_min=WINDOW[0], time_max=WINDOW[1]
    )


@query(
    "histogram_totals",
    _histogram_sql("true", 60)
    + """ SELECT CAST(sum(trace + debug + info + warn + error + fatal) AS BIGINT) AS total,
    CAST(max(trace + debug + info + warn + error + fatal) AS BIGINT) AS peak, CAST(sum(warn) AS BIGINT) AS warnings,
    CAST(sum(error + fatal) AS BIGINT) AS errors, count(*) AS buckets FROM histogram""",
)
def histogram_totals(spark, sf_dir):
    return logs.histogram_totals(logs.log_histogram(logs_of(spark, sf_dir), 60))


# ---- fields


def _ranked_sql(observations: str, fields_kept: int = 50) -> str:
    return f"""counted AS (SELECT name, value, count(*) AS n FROM ({observations}) o GROUP BY 1, 2),
totals AS (SELECT name, CAST(sum(n) AS BIGINT) AS count FROM counted GROUP BY name ORDER BY count DESC, name LIMIT {fields_kept}),
best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS r FROM counted)
SELECT name, count, string_agg(value || '=' || n, '|' ORDER BY r) AS top_values
FROM totals JOIN best USING (name) WHERE r <= 5 GROUP BY name, count"""


def _listed(ranked):
    top = F.transform("top_values", lambda v: F.concat_ws("=", v["value"], v["count"].cast("string")))
    return ranked.withColumn("top_values", F.array_join(top, "|"))


_LOG_OBSERVATIONS = """SELECT 'service' AS name, service_name AS value FROM logs UNION ALL SELECT 'level', level FROM logs
UNION ALL SELECT 'scope', scope_name FROM logs WHERE scope_name <> ''
UNION ALL SELECT 'k', json_extract_string(attributes, '$.k') FROM logs
UNION ALL SELECT 'service.name', json_extract_string(resource_attributes, '$."service.name"') FROM logs"""


@query("log_fields", f"{WITH_LOGS}, {_ranked_sql(_LOG_OBSERVATIONS)}")
def log_fields(spark, sf_dir):
    return _listed(logs.log_fields(logs_of(spark, sf_dir)))


# Leaves of the two attribute shapes; JSON null reads as the text null.
_LEAVES = """SELECT trace_id, span_id, 'http.method' AS name, json_extract_string(attributes, '$."http.method"') AS value FROM {0}
UNION ALL SELECT trace_id, span_id, 'http.status_code', json_extract_string(attributes, '$."http.status_code"') FROM {0} WHERE parent_span_id = ''
UNION ALL SELECT trace_id, span_id, 'order.customer', json_extract_string(attributes, '$.order.customer') FROM {0} WHERE parent_span_id = ''
UNION ALL SELECT trace_id, span_id, 'order.priority', json_extract_string(attributes, '$.order.priority') FROM {0} WHERE parent_span_id = ''
UNION ALL SELECT trace_id, span_id, 'discount', coalesce(json_extract_string(attributes, '$.discount'), 'null') FROM {0} WHERE parent_span_id <> ''
UNION ALL SELECT trace_id, span_id, 'line.number', json_extract_string(attributes, '$.line.number') FROM {0} WHERE parent_span_id <> ''
UNION ALL SELECT trace_id, span_id, 'line.part', json_extract_string(attributes, '$.line.part') FROM {0} WHERE parent_span_id <> ''
UNION ALL SELECT trace_id, span_id, 'returned', json_extract_string(attributes, '$.returned') FROM {0} WHERE parent_span_id <> ''"""
_RESOURCE_LEAVES = """ UNION ALL SELECT trace_id, span_id, 'host.name', json_extract_string(resource_attributes, '$."host.name"') FROM {0}
UNION ALL SELECT trace_id, span_id, 'service.name', service_name FROM {0}"""


@query("flatten_json", f"{WITH_SPANS} {_LEAVES.format('spans')}")
def flatten_json(spark, sf_dir):
    return fields.flatten_json(spans_of(spark, sf_dir), "attributes", ["trace_id", "span_id"])


@query(
    "flatten_json_deep",
    """SELECT l_orderkey AS id, l_linenumber AS line, repeat('n.', CAST(l_orderkey % 10 AS INT)) || 'flag' AS name, l_returnflag || '{' AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, repeat('n.', CAST(l_orderkey % 10 AS INT)) || 'half', l_linenumber || '.5' FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'top', '[{"a":1}]' FROM lineitem WHERE l_orderkey % 10 > 0""",
)
def flatten_json_deep(spark, sf_dir):
    """Objects of one to ten levels, the depth differing by row."""
    levels = (F.col("l_orderkey") % 10).cast("int")
    inner = F.concat(F.lit('{"flag":"'), "l_returnflag", F.lit('{","half":'), F.col("l_linenumber").cast("string"), F.lit('.5,"none":{}}'))
    first = F.concat(F.lit('{"top":[{"a":1}],"n":'), F.repeat(F.lit('{"n":'), levels - 1), inner, F.repeat(F.lit("}"), levels))
    lines = star_tables.table(spark, sf_dir, "lineitem")
    documents = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.when(levels > 0, first).otherwise(inner).alias("doc"))
    return fields.flatten_json(documents, "doc", ["id", "line"])


@query("trace_fields", f"{WITH_SPANS}, {_ranked_sql((_LEAVES + _RESOURCE_LEAVES).format('spans'))}")
def trace_fields(spark, sf_dir):
    return _listed(fields.trace_fields(spans_of(spark, sf_dir)))


_OF_SERVICE = "own AS (SELECT * FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE service_name = 'RF'))"


@query("trace_fields_service", f"{WITH_SPANS}, {_OF_SERVICE}, {_ranked_sql((_LEAVES + _RESOURCE_LEAVES).format('own'))}")
def trace_fields_service(spark, sf_dir):
    return _listed(fields.trace_fields(spans_of(spark, sf_dir), service="RF"))


@query(
    "rank_fields",
    "WITH " + _ranked_sql("SELECT source || '.' || lang AS name, text AS value FROM documents", 30),
)
def rank_fields(spark, sf_dir):
    documents = star_tables.table(spark, sf_dir, "documents")
    observed = documents.select(F.concat_ws(".", "source", "lang").alias("name"), F.col("text").alias("value"))
    return _listed(fields.rank_fields(observed, 30))


# ---- retention


@query(
    "retention_split",
    f"""{WITH_ALL} SELECT 'spans' AS signal, count(*) FILTER (WHERE start_time_unix_nano < {WINDOW[0]}) AS expired,
      count(*) FILTER (WHERE start_time_unix_nano >= {WINDOW[0]}) AS kept FROM spans
    UNION ALL SELECT 'logs', count(*) FILTER (WHERE time_unix_nano < {WINDOW[0]}), count(*) FILTER (WHERE time_unix_nano >= {WINDOW[0]}) FROM logs
    UNION ALL SELECT 'metric_points', count(*) FILTER (WHERE time_unix_nano < {WINDOW[0]}),
      count(*) FILTER (WHERE time_unix_nano >= {WINDOW[0]}) FROM points""",
)
def retention_split(spark, sf_dir):
    return expired_counts(all_of(spark, sf_dir), WINDOW[0])


@query("keep_newest", f"{WITH_LOGS} SELECT {_LIST} FROM logs ORDER BY time_unix_nano DESC LIMIT 2500")
def keep_newest_logs(spark, sf_dir):
    return keep_newest(star_tables.event_logs(events_of(spark, sf_dir)), 2500).select(*_COLUMNS)
