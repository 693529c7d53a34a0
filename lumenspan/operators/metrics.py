"""Metric series: selection, downsampling, rates, aggregation and exemplars.

A series is the points of one (service, attributes) pair.  Series stay in long form, one row per point,
in the columns ``service_name, attributes, time_unix_nano, value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.filters import on_dates, time_between
from lumenspan.functions.jsontext import canonical
from lumenspan.operators.correlate import exemplar_rows
from lumenspan.plans.limits import at_least, first_rows
from lumenspan.plans.ordered import every_nth, with_previous

SERIES = ["service_name", "attributes"]
TIME = "time_unix_nano"
DEFAULT_POINTS = 500
DEFAULT_EXEMPLARS = 50
AGGREGATE_BUCKETS = 120
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def list_metrics(points: DataFrame) -> DataFrame:
    """One row per metric name; description, unit and type come from its earliest point."""
    first = F.min(F.struct(TIME, "description", "unit", "metric_type"))
    grouped = points.groupBy("name").agg(
        first.alias("first"), F.array_sort(F.collect_set("service_name")).alias("services")
    )
    return grouped.select("name", "first.description", "first.unit", "first.metric_type", "services").orderBy("name")


def metric_series(
    points: DataFrame,
    name: str,
    service: str | None = None,
    time_min: int | None = None,
    time_max: int | None = None,
    canonical_attributes: bool = False,
) -> DataFrame:
    """Points of a metric as series.  Stored attributes are canonical; other text can be made so here."""
    kept = on_dates(points, time_min=time_min, time_max=time_max)
    kept = kept.filter((F.col("name") == name) & time_between(TIME, time_min, time_max))
    if service:
        kept = kept.filter(F.col("service_name") == service)
    key = canonical("attributes") if canonical_attributes else F.col("attributes")
    return kept.select(
        F.coalesce("service_name", F.lit("")).alias("service_name"),
        F.coalesce(key, F.lit("{}")).alias("attributes"),
        TIME,
        "value",
    )


def downsample(series: DataFrame, max_points: int = DEFAULT_POINTS) -> DataFrame:
    """At most max_points per series by a constant stride; shorter series keep every point."""
    limit = at_least("max_points", max_points)
    return every_nth(series, SERIES, [TIME, "value"], limit)


def _steps(series: DataFrame, bounded: bool) -> DataFrame:
    """Consecutive points of different time: the last value before and the first value at each time.

    Points of equal time are ordered by value and never form a step among themselves, so each time is
    reduced to its smallest and largest value before anything is shuffled.
    """
    moments = series.groupBy(*SERIES, TIME).agg(F.min("value").alias("first"), F.max("value").alias("last"))
    return with_previous(moments, SERIES, TIME, "last", None if bounded else series).filter(F.col("previous").isNotNull())


def rate(series: DataFrame, bounded: bool = False) -> DataFrame:
    """Change per second between consecutive points; after a reset the new value is the change.

    ``bounded`` is for downsampled series, whose length is limited.
    """
    change = F.col("first") - F.col("previous")
    seconds = (F.col(TIME) - F.col("previous_time")) / 1e9
    grown = F.when(change < 0, F.col("first")).otherwise(change)
    return _steps(series, bounded).select(*SERIES, TIME, (grown / seconds).alias("value"))


def increase(series: DataFrame, bounded: bool = False) -> DataFrame:
    """Change between consecutive points; a reset counts as no change."""
    change = F.col("first") - F.col("previous")
    return _steps(series, bounded).select(*SERIES, TIME, F.when(change < 0, 0.0).otherwise(change).alias("value"))


FUNCTIONS = {"rate": rate, "increase": increase}


def _without_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def aggregate_series(
    series: DataFrame, function: str, buckets: int = AGGREGATE_BUCKETS, of: DataFrame | None = None
) -> DataFrame:
    """All series folded into one: mean per series in each time slot, then ``function`` across series.

    ``of`` names the rows whose series are counted, where a step before has emptied some.
    """
    if function not in AGGREGATES:
        return series
    at_least("buckets", buckets)
    div = lambda a, b: F.call_function("div", a, b)
    ends = series.agg(F.struct(F.min(TIME).alias("lo"), F.max(TIME).alias("hi")).alias("b")).scalar()
    # The bounds travel with the rows, so that the plan contains the subquery once.
    ranged = series.withColumn("__ends", ends)
    low = F.col("__ends.lo")
    width = F.greatest(div(F.greatest(F.col("__ends.hi"), low + 1) - low, F.lit(buckets)), F.lit(1).cast("bigint"))
    slot = F.least(div(F.col(TIME) - low, width), F.lit(buckets - 1))
    middle = low + slot * width + div(width, F.lit(2))
    means = ranged.groupBy(middle.alias(TIME), *SERIES).agg(F.avg("value").alias("value"))
    value = _without_nan(F.col("value")) if function in ("min", "max") else F.col("value")
    folded = means.groupBy(TIME).agg(AGGREGATES[function](value).alias("value"))
    count = (series if of is None else of).select(*SERIES).distinct().agg(F.count("*")).scalar()
    label = F.concat(F.lit(f'{{"aggregation":"{function}","series":'), count.cast("string"), F.lit("}"))
    return folded.select(
        F.lit(function).alias("service_name"),
        label.alias("attributes"),
        TIME,
        "value",
    )


def metric_query(
    points: DataFrame,
    name: str,
    function: str = "raw",
    aggregation: str = "none",
    max_points: int = DEFAULT_POINTS,
    **selection,
) -> DataFrame:
    """Select, downsample, transform, aggregate."""
    selected = metric_series(points, name, **selection)
    series = downsample(selected, max_points)
    if function in FUNCTIONS:
        series = FUNCTIONS[function](series, bounded=True)
    return aggregate_series(series, aggregation, of=selected)


def series_stats(series: DataFrame) -> DataFrame:
    """Points, first, last, smallest, largest and mean value and latest time of each series."""
    point = F.struct(TIME, "value")
    value = _without_nan(F.col("value"))
    grouped = series.groupBy(*SERIES).agg(
        F.count("*").alias("points"),
        F.min(point).alias("__first"),
        F.max(point).alias("__last"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg("value").alias("avg_value"),
    )
    return grouped.select(
        *SERIES,
        "points",
        F.col("__first.value").alias("first_value"),
        F.col("__last.value").alias("last_value"),
        "min_value",
        "max_value",
        "avg_value",
        F.col(f"__last.{TIME}").alias("latest_unix_nano"),
    )


def series_points(series: DataFrame, max_points: int = DEFAULT_POINTS) -> DataFrame:
    """Series as one row each with a sorted array of points, downsampled so that the arrays are bounded."""
    points = F.array_sort(F.collect_list(F.struct(TIME, "value")))
    return downsample(series, max_points).groupBy(*SERIES).agg(points.alias("points"))


def find_exemplars(
    points: DataFrame, trace_id: str, span_id: str | None = None, n: int | None = DEFAULT_EXEMPLARS
) -> DataFrame:
    """Newest n (None means all) exemplars of a trace, and of a span if given; blank or all-zero ids find nothing."""
    trace_id, span_id = trace_id.strip().lower(), (span_id or "").strip().lower()
    rows = exemplar_rows(points)
    if not trace_id.strip("0"):
        return rows.limit(0)
    rows = rows.filter(F.lower("trace_id") == trace_id)
    if span_id:
        rows = rows.filter(F.lower("span_id") == span_id)
    order = [F.desc("time_unix_nano"), F.col("metric_name"), F.col("service_name"), F.col("span_id"), F.col("value")]
    return first_rows(rows.orderBy(*order), n, DEFAULT_EXEMPLARS)
