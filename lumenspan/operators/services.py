"""Request, error and latency statistics per service and the graph between services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.filters import name_matches, within
from lumenspan.operators import traces
from lumenspan.operators.traces import is_error, is_root
from lumenspan.plans.ranks import nearest_ranks

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def sampled(spans: DataFrame, sample_traces: int | None) -> DataFrame:
    """All spans, or those of the newest k traces."""
    if sample_traces is None:
        return spans
    return traces.spans_of(spans, traces.candidate_traces(spans, sample_traces), sample_traces)


def latency_percentiles(spans: DataFrame, approximate: bool = False) -> DataFrame:
    """Nearest-rank percentiles of the span duration per service, in milliseconds."""
    if approximate:
        parts = [F.percentile_approx("duration_nanos", p, 10_000).alias(n) for n, p in PERCENTILES.items()]
        ranks = spans.groupBy("service_name").agg(*parts)
    else:
        ranks = nearest_ranks(spans, ["service_name"], "duration_nanos", PERCENTILES)
    return ranks.select("service_name", *((F.col(n) / 1e6).alias(f"{n}_ms") for n in PERCENTILES))


def service_stats(
    spans: DataFrame,
    time_min: int | None = None,
    time_max: int | None = None,
    sample_traces: int | None = None,
    approximate: bool = False,
) -> DataFrame:
    """Requests, errors, rates and latency percentiles of every service in the window.

    Requests are server spans and roots, at least one.  Rates are per second of the span of time that
    all services together cover, at least one second.
    """
    spans = sampled(within(spans, time_min, time_max), sample_traces)
    covered = (F.max("end_time_unix_nano") - F.min("start_time_unix_nano")) / 1e9
    seconds = spans.agg(F.greatest(covered, F.lit(1.0))).scalar()
    requests = F.greatest(F.count_if((F.col("kind") == "server") | is_root()), F.lit(1).cast("bigint"))
    counts = spans.groupBy("service_name").agg(
        F.count("*").alias("span_count"),
        requests.alias("request_count"),
        F.count_if(is_error()).alias("error_count"),
    )
    rates = counts.withColumns(
        {
            "error_rate": F.col("error_count") / F.col("span_count"),
            "rate_per_sec": F.col("request_count") / seconds,
        }
    )
    cuts = latency_percentiles(spans, approximate).withColumnRenamed("service_name", "__service")
    return rates.join(cuts, F.col("service_name").eqNullSafe(F.col("__service")), "left").drop("__service")


def unhealthy_first(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("error_rate"), F.desc("p95_ms"), "service_name")


def service_graph_nodes(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service_name").agg(
        F.count("*").alias("span_count"),
        F.count_if(is_error()).alias("error_count"),
        (F.sum("duration_nanos") / F.count("*") / 1e6).alias("avg_ms"),
    )


def service_graph_edges(spans: DataFrame) -> DataFrame:
    """Calls from one service to another: a child span whose parent belongs to a different service.

    Children are reduced per parent and service before the join, so a parent with many children is a
    few rows; both join sides then have a bounded number of rows per key.
    """
    children = (
        spans.filter(~is_root())
        .groupBy("trace_id", "parent_span_id", F.col("service_name").alias("target"))
        .agg(
            F.count("*").alias("calls"),
            F.count_if(is_error()).alias("errors"),
            F.sum("duration_nanos").alias("nanos"),
        )
    )
    parents = spans.groupBy("trace_id", F.col("span_id").alias("parent_span_id")).agg(
        F.min("service_name").alias("source")
    )
    edges = children.join(parents, ["trace_id", "parent_span_id"]).filter(F.col("source") != F.col("target"))
    return edges.groupBy("source", "target").agg(
        F.sum("calls").alias("calls"),
        F.sum("errors").alias("errors"),
        (F.sum("nanos") / F.sum("calls") / 1e6).alias("avg_ms"),
    )


def filter_graph(nodes: DataFrame, edges: DataFrame, term: str) -> tuple[DataFrame, DataFrame]:
    """Matching nodes, and the edges that have both ends among them."""
    kept = nodes.filter(name_matches("service_name", term))
    names = kept.select("service_name").distinct()
    for end in ("source", "target"):
        # Inner joins with unique names stay above the aggregation that made the edges.
        edges = edges.join(names.select(F.col("service_name").alias(end)), end)
    return kept, edges.select("source", "target", "calls", "errors", "avg_ms")


def storage_stats(spans: DataFrame, logs: DataFrame, points: DataFrame) -> DataFrame:
    """Row counts of the three tables and the number of services over all of them."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("service_name").agg(F.count("*").alias("n")).withColumn("signal", F.lit(name))

    # One row per signal and service is left before the services are compared.
    rows = counted(spans, "spans").unionByName(counted(logs, "logs")).unionByName(counted(points, "metric_points"))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("signal") == name, F.col("n"))), F.lit(0)).alias(name)
    return rows.agg(
        total("spans"), total("logs"), total("metric_points"), F.count_distinct("service_name").alias("services")
    )
