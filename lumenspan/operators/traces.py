"""Trace search, summaries and trees."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspan.functions.filters import STATUS_ERROR, on_dates, span_filter
from lumenspan.functions.spansets import TraceCondition, TraceFlags
from lumenspan.operators import correlate
from lumenspan.plans import forests
from lumenspan.plans.checkpoints import stored
from lumenspan.plans.limits import first_rows
from lumenspan.plans.ordered import with_next
from lumenspan.session import ship

DEFAULT_TRACES = 20
# Ids of a top-k are broadcast up to this many rows.
BROADCAST_IDS = 10_000
# Trees of up to this many spans are walked inside one task.
SPANS_IN_TASK = 100_000

SUMMARY_COLUMNS = [
    "trace_id",
    "root_name",
    "root_service",
    "start_time_unix_nano",
    "duration_nanos",
    "span_count",
    "error_count",
    "services",
]


def is_error() -> Column:
    return F.col("status_code") == STATUS_ERROR


def is_root() -> Column:
    return F.col("parent_span_id") == ""


def list_services(*signals: DataFrame) -> DataFrame:
    """Distinct service names over any of the three signals, sorted."""
    names = [df.select("service_name").distinct() for df in signals]
    union = names[0]
    for more in names[1:]:
        union = union.unionByName(more)
    return union.distinct().orderBy("service_name")


def list_operations(spans: DataFrame, service: str | None = None) -> DataFrame:
    """Distinct span names, of one service or of all."""
    if service:
        spans = spans.filter(F.col("service_name") == service)
    return spans.select("name").distinct().orderBy("name")


def summary_aggregates() -> list[Column]:
    root = F.struct(
        (~is_root()).alias("is_child"), "start_time_unix_nano", "span_id", "name", "service_name"
    )
    return [
        # The earliest parentless span, or the earliest span where the root was not received.
        F.min(root).alias("__root"),
        F.min("start_time_unix_nano").alias("start_time_unix_nano"),
        F.max("end_time_unix_nano").alias("__end"),
        F.count("*").alias("span_count"),
        F.count_if(is_error()).alias("error_count"),
        F.array_sort(F.collect_set("service_name")).alias("services"),
    ]


def summary_columns(grouped: DataFrame) -> DataFrame:
    return grouped.withColumns(
        {
            "root_name": F.col("__root.name"),
            "root_service": F.col("__root.service_name"),
            "duration_nanos": F.greatest(F.col("__end") - F.col("start_time_unix_nano"), F.lit(0).cast("bigint")),
        }
    )


def _newest_first(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc("start_time_unix_nano"), "trace_id")


def summarise(spans: DataFrame) -> DataFrame:
    """One row per trace, in no particular order."""
    grouped = spans.groupBy("trace_id").agg(*summary_aggregates())
    return summary_columns(grouped).select(*SUMMARY_COLUMNS)


def trace_summaries(spans: DataFrame) -> DataFrame:
    """One row per trace, newest first."""
    return _newest_first(summarise(spans))


def candidate_traces(spans: DataFrame, k: int | None = 0, **filters) -> DataFrame:
    """Newest k traces (0 means 20, None all) with a span that satisfies all span filters, by its latest start."""
    matching = on_dates(spans, **filters).filter(span_filter(**filters))
    latest = matching.groupBy("trace_id").agg(F.max("start_time_unix_nano").alias("latest_start"))
    return first_rows(latest.orderBy(F.desc("latest_start"), "trace_id"), k, DEFAULT_TRACES)


def trace_ids(spans: DataFrame, k: int | None = 0, **filters) -> DataFrame:
    return candidate_traces(spans, k, **filters).select("trace_id")


def spans_of(spans: DataFrame, ids: DataFrame, k: int | None) -> DataFrame:
    """All spans of the given traces; k is how many there are at most, if known."""
    ids = ids.select("trace_id")
    few = k is not None and k <= BROADCAST_IDS
    return spans.join(F.broadcast(ids) if few else ids, "trace_id", "left_semi")


def find_traces(spans: DataFrame, k: int | None = 0, **filters) -> DataFrame:
    """Summaries of the candidate traces over all of their spans, newest first."""
    k = DEFAULT_TRACES if k == 0 else k
    return trace_summaries(spans_of(spans, candidate_traces(spans, k, **filters), k))


def get_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of a trace by start; no rows for an unknown id."""
    return spans.filter(F.col("trace_id") == trace_id).orderBy("start_time_unix_nano", "span_id")


def _context(spans: DataFrame) -> DataFrame:
    """What conditions can ask of a whole trace: its root and duration."""
    root, start, end, *_ = summary_aggregates()
    return summary_columns(spans.groupBy("trace_id").agg(root, start, end)).select("trace_id", "root_name", "root_service", "duration_nanos")


def _spans_of_matching(spans: DataFrame, condition: TraceCondition | None, **filters) -> DataFrame:
    """All spans of the traces that have a span passing the filters and satisfy the condition.

    Filters pick traces first, where they reach the scan and its date partitions.  Of the rest, only spans that can
    belong to a span set are grouped.
    """
    if any(value not in (None, "", False) for value in filters.values()):
        picked = on_dates(spans, **filters).filter(span_filter(**filters)).select("trace_id").distinct()
        spans = spans.join(picked, "trace_id", "left_semi")
    if condition is None:
        return spans
    found = TraceFlags(condition).matching(spans, lambda ids: _context(spans.join(ids, "trace_id", "left_semi")))
    return spans.join(found, "trace_id", "left_semi")


def matching_traces(spans: DataFrame, condition: TraceCondition | None = None, **filters) -> DataFrame:
    """Summaries of every trace that has a span passing the filters and satisfies the condition."""
    return summarise(_spans_of_matching(spans, condition, **filters))


def search_traces(
    spans: DataFrame, condition: TraceCondition | None = None, k: int | None = DEFAULT_TRACES, **filters
) -> DataFrame:
    """Newest k matching traces of the whole table; None means all.

    Of all matching traces only the start is looked for; the newest k are summarised.
    """
    own = _spans_of_matching(spans, condition, **filters)
    if k is None:
        return trace_summaries(own)
    k = k or DEFAULT_TRACES
    starts = own.groupBy("trace_id").agg(F.min("start_time_unix_nano").alias("start_time_unix_nano"))
    return trace_summaries(spans_of(spans, first_rows(_newest_first(starts), k, DEFAULT_TRACES), k))


def error_spans(spans: DataFrame) -> DataFrame:
    return spans.filter(is_error()).select(
        "trace_id", "span_id", "name", "service_name", "status_message", "start_time_unix_nano", "duration_nanos"
    )


ENTER, LEAVE = 0, 1


def _tour(spans: DataFrame) -> DataFrame:
    """Steps of a walk around every tree: (trace_id, span_id, step), the step after it, spans entered and levels climbed.

    A span with children is entered and left, one without is a single step.  Tops (roots, and spans whose parent was
    not received) are children of the trace, in order of start.  Spans sent twice are one node, their earliest copy.
    """
    node = F.struct(F.col("start_time_unix_nano").alias("start"), F.col("parent_span_id").alias("parent"))
    nodes = spans.groupBy("trace_id", "span_id").agg(F.min(node).alias("n")).select("trace_id", "span_id", "n.start", "n.parent")
    known = nodes.select("trace_id", F.col("span_id").alias("parent"), F.lit(True).alias("received"))
    below = F.coalesce("received", F.lit(False)) & (F.col("parent") != F.col("span_id"))
    placed = nodes.join(known, ["trace_id", "parent"], "left").select("trace_id", "span_id", "start", F.when(below, F.col("parent")).otherwise("").alias("parent"))
    siblings = with_next(placed, ["trace_id", "parent"], ["start", "span_id"], "span_id", "sibling")
    siblings = stored(siblings, "siblings")
    eldest = siblings.filter(F.col("parent") != "").groupBy("trace_id", F.col("parent").alias("span_id"))
    eldest = eldest.agg(F.min_by("span_id", F.struct("start", "span_id")).alias("child"))
    families = siblings.join(eldest, ["trace_id", "span_id"], "left")
    step = lambda span, kind: F.struct(span.alias("span"), F.lit(kind).alias("step"))
    onwards = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), ENTER)).when(F.col("parent") != "", step(F.col("parent"), LEAVE))
    row = lambda kind, then, entered, climbed: F.struct(
        F.lit(kind).alias("step"), then.alias("then"), F.lit(entered).cast("bigint").alias("entered"), F.lit(climbed).cast("bigint").alias("climbed")
    )
    both = F.array(row(ENTER, step(F.col("child"), ENTER), 1, -1), row(LEAVE, onwards, 0, 1))
    steps = F.when(F.col("child").isNotNull(), both).otherwise(F.array(row(ENTER, onwards, 1, 0)))
    return families.select("trace_id", "span_id", F.explode(steps).alias("s")).select("trace_id", "span_id", "s.*")


def span_positions(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, position): level in the tree and place in pre-order, both from 0.

    The steps of the walk around a trace's trees are a list.  Every round doubles how far each step looks ahead, so
    n spans need log2(2 n) rounds; steps that have reached the end are written once and only looked up afterwards.
    What lies behind a step tells how many spans were entered before it and how many are still open.  Spans on, or
    below, a parent cycle never reach an end: they keep NULLs.
    """
    open_steps = stored(_tour(spans), "tour")
    done = open_steps.filter(F.col("then").isNull())
    open_steps = open_steps.filter(F.col("then").isNotNull())
    left = open_steps.count()
    while left:
        ahead = open_steps.unionByName(done).select(
            "trace_id", F.col("span_id").alias("at_span"), F.col("step").alias("at_step"),
            F.col("then").alias("next"), F.col("entered").alias("more"), F.col("climbed").alias("higher"),
        )
        looked = open_steps.withColumns({"at_span": F.col("then.span"), "at_step": F.col("then.step")})
        looked = looked.join(ahead, ["trace_id", "at_span", "at_step"]).select(
            "trace_id", "span_id", "step", F.col("next").alias("then"),
            (F.col("entered") + F.col("more")).alias("entered"), (F.col("climbed") + F.col("higher")).alias("climbed"),
        )
        looked = stored(looked, "tour")
        done = done.unionByName(looked.filter(F.col("then").isNull()))
        open_steps = looked.filter(F.col("then").isNotNull())
        remaining, left = left, open_steps.count()
        # A round that finishes no step has only cycles left.
        if left == remaining:
            break
    entries = done.filter(F.col("step") == ENTER)
    totals = entries.groupBy("trace_id").agg(F.max("entered").alias("spans"))
    placed = entries.join(totals, "trace_id")
    return placed.select("trace_id", "span_id", F.col("climbed").alias("depth"), (F.col("spans") - F.col("entered")).alias("position"))


def split_by_size(spans: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Spans of traces that fit into a task, and those of larger ones (None where there are none).

    Rows without a trace id belong to no trace.
    """
    spans = spans.filter(F.col("trace_id").isNotNull())
    sizes = spans.groupBy("trace_id").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(F.col("n") > SPANS_IN_TASK).select("trace_id"), "large")
    if large.isEmpty():
        return spans, None
    # At most one id for every SPANS_IN_TASK rows.
    return tuple(spans.join(F.broadcast(large), "trace_id", how) for how in ("left_anti", "left_semi"))


TREE_COLUMNS = [
    "trace_id", "span_id", "parent_span_id", "name", "service_name", "status_code", "status_message",
    "start_time_unix_nano", "duration_nanos",
]


def _placed_in_tasks(spans: DataFrame) -> DataFrame:
    """Rows with the bounds of their trace, depth and position; the spans of a trace meet in one task."""
    trace = W.partitionBy("trace_id")
    rows = spans.select(
        *TREE_COLUMNS,
        F.min("start_time_unix_nano").over(trace).alias("__first"),
        F.max("end_time_unix_nano").over(trace).alias("__last"),
        F.count("*").over(trace).alias(forests.SIZE),
        F.coalesce("parent_span_id", F.lit("")).alias(forests.PARENT),
        # A missing start comes first.
        F.coalesce("start_time_unix_nano", F.lit(-(2**63))).alias(forests.ORDER),
    )
    # The window has brought traces together in this order, so nothing is sorted again.
    rows = rows.sortWithinPartitions("trace_id")
    kept = [f for f in rows.schema.fields if f.name not in (forests.SIZE, forests.PARENT, forests.ORDER)]
    places = [T.StructField(name, T.LongType()) for name in ("depth", "position")]
    ship(spans.sparkSession)
    return rows.mapInArrow(forests.place_batches, T.StructType([*kept, *places]))


def _placed_in_rounds(spans: DataFrame) -> DataFrame:
    """The same for traces of any size, each spread over the cluster."""
    bounds = spans.groupBy("trace_id").agg(
        F.min("start_time_unix_nano").alias("__first"), F.max("end_time_unix_nano").alias("__last")
    )
    return spans.select(*TREE_COLUMNS).join(span_positions(spans), ["trace_id", "span_id"], "left").join(bounds, "trace_id")


def trace_tree(spans: DataFrame, ordered: bool = False) -> DataFrame:
    """Every span with its depth and its ``position`` in the pre-order of its trace, sorted by it if ``ordered``.

    Roots and orphans have depth 0, siblings are ordered by start, offsets are relative to the trace.  Spans on, or
    below, a parent cycle have neither depth nor position.
    """
    ordinary, large = split_by_size(spans)
    placed = _placed_in_tasks(ordinary)
    if large is not None:
        placed = placed.unionByName(_placed_in_rounds(large))
    total = F.greatest(F.col("__last") - F.col("__first"), F.lit(1))
    offset = F.col("start_time_unix_nano") - F.col("__first")
    tree = placed.select(
        *TREE_COLUMNS,
        "depth",
        offset.alias("offset_nanos"),
        (offset / total).alias("offset_share"),
        (F.col("duration_nanos") / total).alias("width_share"),
        "position",
    )
    return tree.orderBy("trace_id", F.asc_nulls_last("position"), "span_id", "duration_nanos") if ordered else tree


def trace_completeness(spans: DataFrame) -> DataFrame:
    """Per trace the spans whose parent was not received, and whether the root is missing."""
    # Children are counted per parent first, so a parent with many children joins as one row.
    children = (
        spans.filter(~is_root())
        .groupBy("trace_id", "parent_span_id")
        .agg(F.count("*").alias("children"))
    )
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct().withColumn("__known", F.lit(True))
    # Not an anti join: the optimizer would move that below the counting.
    orphans = (
        children.join(known, ["trace_id", "parent_span_id"], "left")
        .filter(F.col("__known").isNull())
        .groupBy("trace_id")
        .agg(F.sum("children").alias("orphans"))
    )
    traces = spans.groupBy("trace_id").agg(
        F.count("*").alias("span_count"), (F.count_if(is_root()) == 0).alias("root_missing")
    )
    return traces.join(orphans, "trace_id", "left").select(
        "trace_id", "span_count", F.coalesce("orphans", F.lit(0)).alias("orphan_count"), "root_missing"
    )


class Investigation(NamedTuple):
    status: DataFrame
    spans: DataFrame
    errors: DataFrame
    logs: DataFrame
    exemplars: DataFrame


def investigate(
    spans: DataFrame, logs: DataFrame, points: DataFrame, ids: list[str] | DataFrame, logs_per_trace: int = 100
) -> Investigation:
    """Everything known about the given traces: texts, or a table with ``trace_id``.

    ``status`` has one row per requested id; ``found`` is false where no span was received.
    """
    if isinstance(ids, DataFrame):
        wanted = ids.select("trace_id").distinct()
        chosen = lambda df: df.join(wanted, "trace_id", "left_semi").select(*df.columns)
        folded = wanted.select(F.lower("trace_id").alias("trace_id"))
        exemplars = correlate.metrics_of_traces(points, folded)
    else:
        wanted = spans.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("trace_id"))
        chosen = lambda df: df.filter(F.col("trace_id").isin(*ids))
        exemplars = correlate.exemplar_rows(points).filter(F.lower("trace_id").isin(*(i.lower() for i in ids)))
    own = chosen(spans)
    status = wanted.join(summarise(own), "trace_id", "left").select(
        "trace_id",
        F.col("span_count").isNotNull().alias("found"),
        F.coalesce("span_count", F.lit(0)).alias("span_count"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        F.coalesce("services", F.array().cast("array<string>")).alias("services"),
    )
    return Investigation(
        status=status,
        spans=own.orderBy("trace_id", "start_time_unix_nano", "span_id"),
        errors=error_spans(own),
        logs=correlate.newest_per_trace(chosen(logs), logs_per_trace),
        exemplars=exemplars,
    )
