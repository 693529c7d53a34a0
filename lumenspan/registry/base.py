"""Registration of queries with their independent SQL, and the tables both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.session import configure
from lumenspan.sources import star_tables
from lumenspan.sources.tables import Telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPANS_SQL = """
spans AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, CAST(o_orderkey AS VARCHAR) AS span_id, '' AS parent_span_id,
    'order ' || o_orderstatus AS name, o_orderpriority AS service_name, 'server' AS kind,
    epoch_us(o_orderdate) * 1000 AS start_time_unix_nano,
    epoch_us(o_orderdate) * 1000 + CAST(floor(o_totalprice) AS BIGINT) * 1000000 AS end_time_unix_nano,
    CAST(floor(o_totalprice) AS BIGINT) * 1000000 AS duration_nanos,
    CAST(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS INTEGER) AS status_code,
    CASE o_orderstatus WHEN 'F' THEN 'order failed' ELSE '' END AS status_message,
    '{"http.method":"POST","http.status_code":' || CASE o_orderstatus WHEN 'F' THEN '500' ELSE '200' END
      || ',"order":{"customer":' || o_custkey || ',"priority":"' || o_orderpriority || '"}}' AS attributes,
    '{"host.name":"host-' || (o_custkey % 4) || '","service.name":"' || o_orderpriority || '"}' AS resource_attributes
  FROM orders
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR),
    'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT),
    CAST(l_orderkey AS VARCHAR), 'line ' || l_linenumber, l_returnflag || l_linestatus,
    CASE l_linestatus WHEN 'O' THEN 'client' ELSE 'internal' END,
    epoch_us(l_shipdate) * 1000, epoch_us(l_shipdate) * 1000 + CAST(l_quantity AS BIGINT) * 1000000,
    CAST(l_quantity AS BIGINT) * 1000000,
    CAST(CASE l_returnflag WHEN 'R' THEN 2 ELSE 0 END AS INTEGER),
    CASE l_returnflag WHEN 'R' THEN 'returned' ELSE '' END,
    '{"discount":' || CASE WHEN CAST(round(l_discount * 100) AS BIGINT) = 0 THEN 'null'
      ELSE CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR) END
      || ',"http.method":"GET","line":{"number":' || l_linenumber || ',"part":' || l_partkey
      || '},"returned":' || CASE l_returnflag WHEN 'R' THEN 'true' ELSE 'false' END || '}',
    '{"host.name":"host-' || (l_suppkey % 4) || '","service.name":"' || l_returnflag || l_linestatus || '"}'
  FROM lineitem)
"""

LOGS_SQL = """
logs AS (
  SELECT epoch_us(ts) * 1000 AS time_unix_nano,
    CAST(CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'purchase' THEN 9 WHEN 'click' THEN 5
      WHEN 'view' THEN 1 ELSE 0 END AS INTEGER) AS severity_number,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO'
      WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'TRACE' ELSE '' END AS severity_text,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'info'
      WHEN 'click' THEN 'debug' WHEN 'view' THEN 'trace' ELSE 'unset' END AS level,
    event_type AS body, '"' || event_type || '"' AS body_json, props AS attributes,
    '{"service.name":"svc-' || (user_id % 8) || '"}' AS resource_attributes,
    'svc-' || (user_id % 8) AS service_name, CAST(user_id AS VARCHAR) AS trace_id,
    CASE WHEN event_type IN ('error', 'purchase') THEN CAST(user_id AS VARCHAR) ELSE '' END AS span_id,
    CASE WHEN event_type IN ('error', 'purchase') THEN 'web' ELSE '' END AS scope_name
  FROM events)
"""

POINTS_SQL = """
points AS (
  SELECT event_type AS name, 'value of ' || event_type AS description, '1' AS unit, 'gauge' AS metric_type,
    'svc-' || (user_id % 8) AS service_name, epoch_us(ts) * 1000 AS time_unix_nano, value,
    '{"user":' || (user_id % 4) || '}' AS attributes,
    '{"service.name":"svc-' || (user_id % 8) || '"}' AS resource_attributes,
    CASE WHEN event_type IN ('error', 'purchase') THEN CAST(user_id AS VARCHAR) END AS exemplar_trace
  FROM events)
"""

# Documents as logs: the whole text is the body.
DOCS_SQL = """
docs AS (
  SELECT doc_id, text AS body, source AS service_name,
    '{"chars":' || n_chars || ',"lang":"' || lang || '"}' AS attributes,
    '{"service.name":"' || source || '"}' AS resource_attributes
  FROM documents)
"""


def with_sql(*tables: str) -> str:
    return "WITH " + ", ".join(part.strip() for part in tables)


WITH_SPANS = with_sql(SPANS_SQL)
WITH_LOGS = with_sql(LOGS_SQL)
WITH_POINTS = with_sql(POINTS_SQL)
WITH_DOCS = with_sql(DOCS_SQL)
WITH_ALL = with_sql(SPANS_SQL, LOGS_SQL, POINTS_SQL)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` is its twin over the same tables."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.order_spans(spark, sf_dir)


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.table(spark, sf_dir, "events")


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.event_logs(events_of(spark, sf_dir))


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.event_points(events_of(spark, sf_dir))


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document logs with their numeric id."""
    logs = star_tables.document_logs(star_tables.table(spark, sf_dir, "documents"))
    return logs.withColumn("doc_id", F.col("span_id").cast("bigint"))


def all_of(spark: SparkSession, sf_dir: str) -> Telemetry:
    return star_tables.telemetry(spark, sf_dir)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def joined(name: str) -> Column:
    return F.array_join(F.col(name), ",").alias(name)
