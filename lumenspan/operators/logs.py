"""Log search, volume histogram and log fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.filters import log_filter, on_dates
from lumenspan.functions.records import severity_level
from lumenspan.operators.correlate import newest_log_order
from lumenspan.operators.fields import attribute_observations, rank_fields
from lumenspan.plans.limits import at_least, first_rows

DEFAULT_LOGS = 200

# Severity ranges of the histogram; every other number counts as info.
HISTOGRAM_LEVELS = {"trace": (1, 4), "debug": (5, 8), "warn": (13, 16), "error": (17, 20), "fatal": (21, 24)}
LEVEL_COLUMNS = ["trace", "debug", "info", "warn", "error", "fatal"]


def query_logs(logs: DataFrame, n: int | None = 0, **filters) -> DataFrame:
    """Newest n logs (0 means 200, None all) that pass the structured filters."""
    kept = on_dates(logs, **filters).filter(log_filter(**filters))
    return first_rows(kept.orderBy(*newest_log_order()), n, DEFAULT_LOGS)


def search_logs(logs: DataFrame, predicate: Column, n: int | None = DEFAULT_LOGS, **filters) -> DataFrame:
    """Newest n logs (None means all) of the whole window that pass the filters and the predicate."""
    return query_logs(logs.filter(predicate), n, **filters)


def level_counts() -> list[Column]:
    """One count per histogram level."""
    severity = F.col("severity_number")
    counts, known = {}, F.lit(False)
    for name, (low, high) in HISTOGRAM_LEVELS.items():
        counts[name] = F.count_if(severity.between(low, high))
        known = known | severity.between(low, high)
    counts["info"] = F.count_if(~F.coalesce(known, F.lit(False)))
    return [counts[name].alias(name) for name in LEVEL_COLUMNS]


def log_histogram(
    logs: DataFrame,
    buckets: int = 60,
    predicate: Column | None = None,
    time_min: int | None = None,
    time_max: int | None = None,
    **filters,
) -> DataFrame:
    """Log counts per level in equal time buckets.

    The range is the given window, else that of the data.  The last bucket takes the remainder, empty ones are present, and no matching log means no rows.
    """
    at_least("buckets", buckets)
    kept = on_dates(logs, time_min=time_min, time_max=time_max).filter(log_filter(time_min=time_min, time_max=time_max, **filters))
    if predicate is not None:
        kept = kept.filter(predicate)
    time = "time_unix_nano"
    low, high = F.lit(time_min), F.lit(time_max)
    if time_min is None or time_max is None:
        ends = kept.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("b")).scalar()
        # The bounds travel with the rows, so that the plan contains the subquery once.
        kept = kept.withColumn("__ends", ends)
        low = F.col("__ends.lo") if time_min is None else low
        high = F.col("__ends.hi") if time_max is None else high
    low = low.cast("bigint")
    div = lambda a, b: F.call_function("div", a, b)
    width = F.greatest(div(F.greatest(high.cast("bigint"), low + 1) - low, F.lit(buckets)), F.lit(1).cast("bigint"))
    bucket = F.least(div(F.col(time) - low, width), F.lit(buckets - 1).cast("bigint")).alias("bucket")
    counted = kept.groupBy(bucket, low.alias("low"), width.alias("width")).agg(*level_counts())
    # At most one row per bucket is left, so the zero fill works on a single packed row.
    entry = F.struct("bucket", F.struct(*LEVEL_COLUMNS).alias("counts"))
    found = F.map_from_entries(F.collect_list(entry)).alias("found")
    packed = counted.agg(found, F.first("low").alias("low"), F.first("width").alias("width"))
    rows = packed.filter(F.size("found") > 0).select("found", "low", "width", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("i"))
    at = F.col("i").cast("bigint")
    counts = F.try_element_at("found", at)
    return rows.select(
        (F.col("low") + at * F.col("width")).alias("time_unix_nano"),
        *(F.coalesce(counts[name], F.lit(0)).alias(name) for name in LEVEL_COLUMNS),
    )


def histogram_totals(histogram: DataFrame) -> DataFrame:
    """Sum, busiest bucket, warnings, errors and bucket count of a histogram."""
    total = sum((F.col(name) for name in LEVEL_COLUMNS[1:]), F.col(LEVEL_COLUMNS[0]))
    zero = F.lit(0).cast("bigint")
    return histogram.agg(
        F.coalesce(F.sum(total), zero).alias("total"),
        F.coalesce(F.max(total), zero).alias("peak"),
        F.coalesce(F.sum("warn"), zero).alias("warnings"),
        F.coalesce(F.sum(F.col("error") + F.col("fatal")), zero).alias("errors"),
        F.count("*").alias("buckets"),
    )


def log_fields(logs: DataFrame, fields: int = 50, **filters) -> DataFrame:
    """Service, level, scope and all attribute keys of the matching logs with their top values."""
    kept = on_dates(logs, **filters).filter(log_filter(**filters))

    # Few combinations of these columns exist; they are counted before they become observations.
    builtin = kept.groupBy("service_name", severity_level("severity_number").alias("level"), "scope_name").agg(
        F.count("*").alias("n")
    )
    named = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.col(column).alias("value"))
            for name, column in (("service", "service_name"), ("level", "level"), ("scope", "scope_name"))
        )
    )
    synthetic = builtin.select("n", F.inline(named)).filter((F.col("name") != "scope") | (F.col("value") != ""))
    return rank_fields(attribute_observations(kept).unionByName(synthetic), fields)
