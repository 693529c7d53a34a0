"""Structured filters over the three tables."""

from __future__ import annotations

import time
from collections.abc import Iterable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.jsontext import literal_lookup, truth
from lumenspan.schema import time_column

STATUS_ERROR = 2
CONTEXT_MILLIS = 15 * 60 * 1000
NANOS_PER_MILLI = 1_000_000
NANOS_PER_DAY = 86_400 * 1_000_000_000


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    conditions = list(conditions)
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def window_bounds(
    lookback: timedelta | float | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    now_nanos: int | None = None,
) -> tuple[int | None, int | None]:
    """Inclusive nanosecond bounds.  An absolute start beats the lookback; no lookback means everything."""
    end = None if end_ms is None else end_ms * NANOS_PER_MILLI
    if start_ms is not None:
        return start_ms * NANOS_PER_MILLI, end
    if lookback is None:
        return None, end
    seconds = lookback.total_seconds() if isinstance(lookback, timedelta) else lookback
    now = time.time_ns() if now_nanos is None else now_nanos
    return max(now - int(seconds * 1e9), 0), end


def time_between(column: str, low: int | None, high: int | None) -> Column:
    bounds = []
    if low is not None:
        bounds.append(F.col(column) >= F.lit(low))
    if high is not None:
        bounds.append(F.col(column) <= F.lit(high))
    return all_of(bounds)


def within(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows inside inclusive bounds.  On stored tables the date partitions are pruned as well."""
    return on_dates(df.filter(time_between(time_column(df.columns), low, high)), low, high)


def on_dates(df: DataFrame, time_min: int | None = None, time_max: int | None = None, **_) -> DataFrame:
    """The date partitions of a stored table that a window touches; other filters and other tables pass through."""
    low, high = time_min, time_max
    if "event_date" in df.columns:
        if low is not None:
            df = df.filter(F.col("event_date") >= F.date_from_unix_date(F.lit(low // NANOS_PER_DAY)))
        if high is not None:
            df = df.filter(F.col("event_date") <= F.date_from_unix_date(F.lit(high // NANOS_PER_DAY)))
    return df


def time_window(
    df: DataFrame,
    lookback: timedelta | float | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    now_nanos: int | None = None,
) -> DataFrame:
    """Rows of a span, log or point table inside a relative or absolute window."""
    return within(df, *window_bounds(lookback, start_ms, end_ms, now_nanos))


def context_window(moment_nanos: int) -> tuple[int, int]:
    """(start_ms, end_ms) of the quarter hour before and after a moment."""
    milli = moment_nanos // NANOS_PER_MILLI
    return milli - CONTEXT_MILLIS, milli + CONTEXT_MILLIS


def attribute_filter(query: str) -> Column:
    """``key=value`` on one attribute, anything else as a case-sensitive substring of either attribute text."""
    documents = ("attributes", "resource_attributes")
    if "=" in query:
        key, value = (part.strip() for part in query.split("=", 1))
        return any_of(truth(literal_lookup(doc, key) == F.lit(value)) for doc in documents)
    return any_of(truth(F.col(doc).contains(query)) for doc in documents)


def span_filter(
    service: str | None = None,
    operation: str | None = None,
    errors_only: bool = False,
    min_duration: int | None = None,
    max_duration: int | None = None,
    attribute: str | None = None,
    time_min: int | None = None,
    time_max: int | None = None,
) -> Column:
    """All given conditions on one span.  Cheap comparisons come before the ones that read JSON."""
    conditions = []
    if service:
        conditions.append(F.col("service_name") == service)
    if operation:
        conditions.append(F.col("name") == operation)
    if errors_only:
        conditions.append(F.col("status_code") == STATUS_ERROR)
    if min_duration is not None:
        conditions.append(F.col("duration_nanos") >= min_duration)
    if max_duration is not None:
        conditions.append(F.col("duration_nanos") <= max_duration)
    if time_min is not None or time_max is not None:
        conditions.append(time_between("start_time_unix_nano", time_min, time_max))
    if attribute:
        conditions.append(attribute_filter(attribute))
    return all_of(conditions)


def text_search(term: str) -> Column:
    """Case-insensitive substring of the body JSON, the attributes or the severity text."""
    needle = F.lower(F.lit(term))
    columns = ("body_json", "attributes", "severity_text")
    return any_of(truth(F.lower(F.col(name)).contains(needle)) for name in columns)


def log_filter(
    service: str | None = None,
    min_severity: int | None = None,
    trace_id: str | None = None,
    search: str | None = None,
    time_min: int | None = None,
    time_max: int | None = None,
) -> Column:
    """All given conditions on one log record; empty strings and severities up to zero do not filter."""
    conditions = []
    if service:
        conditions.append(F.col("service_name") == service)
    if min_severity is not None and min_severity > 0:
        conditions.append(F.col("severity_number") >= min_severity)
    if trace_id:
        conditions.append(F.col("trace_id") == trace_id)
    if time_min is not None or time_max is not None:
        conditions.append(time_between("time_unix_nano", time_min, time_max))
    if search:
        conditions.append(text_search(search))
    return all_of(conditions)


def of_span(span_id: str) -> Column:
    """Records of one span."""
    return F.col("span_id") == span_id


def name_matches(column: Column | str, term: str) -> Column:
    """Trimmed, case-insensitive substring; an empty term matches everything."""
    term = term.strip()
    column = F.col(column) if isinstance(column, str) else column
    return truth(F.lower(column).contains(F.lower(F.lit(term)))) if term else F.lit(True)
