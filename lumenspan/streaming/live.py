"""Streaming operators.

They take streaming DataFrames in the table schemas.  Windows use a timestamp derived from the
nanosecond time; with a watermark a window is emitted once it can no longer change.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumenspan.operators.logs import level_counts
from lumenspan.operators.metrics import SERIES, TIME
from lumenspan.operators.traces import summary_aggregates, summary_columns, is_error, is_root
from lumenspan.schema import time_column
from lumenspan.sinks.tables import append
from lumenspan.sources.tables import LOGS_DIR, POINTS_DIR, SPANS_DIR

EVENT_TIME = "event_time"

# For streams of sessions.  Nearly every session of a batch is a group of its own, where maps of groups only fill up
# and are then sorted after all: such a stream sorts at once.  Its open sessions are most of what it keeps on disk.
SESSIONS_CONF = {
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


def with_event_time(df: DataFrame, delay: str | None = None) -> DataFrame:
    """Add the event timestamp, with a watermark if a delay is given."""
    micros = F.floor(F.col(time_column(df.columns)) / F.lit(1000)).cast("bigint")
    timed = df.withColumn(EVENT_TIME, F.timestamp_micros(micros))
    return timed if delay is None else timed.withWatermark(EVENT_TIME, delay)


def start_ingest(rows: DataFrame, path: str, signal: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write flattened rows of a document stream into a stored table, clustered like appended rows.

    Every batch is a part of the table, named after the checkpoint and the batch, and replaced if the batch is
    repeated; appends and sweeps of the same table may run beside it.  ``signal`` is the table folder,
    ``checkpoint`` a folder outside the table, ``trigger`` are arguments of ``DataStreamWriter.trigger``.
    """
    if signal not in (SPANS_DIR, LOGS_DIR, POINTS_DIR):
        raise ValueError(f"no such table: {signal}")
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, number: int) -> None:
        # Range partitioning samples the batch before it writes it.
        batch.persist()
        append(batch, path, signal, part=f"stream-{stream}-{number}")
        batch.unpersist()

    return _started(rows.writeStream.foreachBatch(step), checkpoint, trigger)


def _started(writer: DataStreamWriter, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def live_volume(logs: DataFrame, window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Log counts per level in tumbling windows."""
    timed = with_event_time(logs, delay)
    counted = timed.groupBy(F.window(EVENT_TIME, window).alias("w")).agg(*level_counts())
    return counted.select(_start_nanos("w").alias("time_unix_nano"), *counted.columns[1:])


def _start_nanos(window: str) -> Column:
    return F.unix_micros(F.col(f"{window}.start")) * 1000


def live_red(spans: DataFrame, size: str = "5 minutes", slide: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Requests, errors and approximate latency percentiles per service in sliding windows."""
    timed = with_event_time(spans, delay)
    requests = F.count_if((F.col("kind") == "server") | is_root())
    cuts = F.percentile_approx("duration_nanos", [0.5, 0.95, 0.99], 10_000)
    grouped = timed.groupBy(F.window(EVENT_TIME, size, slide).alias("w"), "service_name").agg(
        F.count("*").alias("span_count"),
        F.greatest(requests, F.lit(1).cast("bigint")).alias("request_count"),
        F.count_if(is_error()).alias("error_count"),
        cuts.alias("cuts"),
    )
    return grouped.select(
        _start_nanos("w").alias("time_unix_nano"),
        "service_name",
        "span_count",
        "request_count",
        "error_count",
        (F.col("error_count") / F.col("span_count")).alias("error_rate"),
        *((F.col("cuts")[i] / 1e6).alias(f"{name}_ms") for i, name in enumerate(("p50", "p95", "p99"))),
    )


def session_traces(spans: DataFrame, gap: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """A summary per trace once no span has started for the gap; start the stream under ``SESSIONS_CONF``."""
    timed = with_event_time(spans, delay)
    session = F.session_window(EVENT_TIME, gap).alias("session")
    closed = summary_columns(timed.groupBy("trace_id", session).agg(*summary_aggregates()))
    return closed.select(
        "trace_id",
        "root_name",
        "root_service",
        "start_time_unix_nano",
        "duration_nanos",
        "span_count",
        "error_count",
        "services",
    )


def deduplicated(spans: DataFrame, delay: str = "10 minutes", keys: tuple[str, ...] = ("trace_id", "span_id")) -> DataFrame:
    """Rows sent again within the delay are dropped."""
    return with_event_time(spans, delay).dropDuplicatesWithinWatermark(list(keys)).drop(EVENT_TIME)


def live_tail(logs: DataFrame, predicate: Column) -> DataFrame:
    """New logs that satisfy a record predicate."""
    return logs.filter(predicate)


def _steps(ttl_ms: int | None) -> StatefulProcessor:
    """Rates of one series; keeps its last moment, and forgets it once the watermark is ``ttl_ms`` past it."""

    # Made in a function, so that it travels as a whole: not every worker that reads it can import this module.
    class Steps(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "time long, value double, known boolean")

        def handleInputRows(self, key, rows, timerValues):
            moments = pd.concat(list(rows)).sort_values(TIME)
            before = self.last.get()
            out = []
            for time, first, last, known in zip(*(moments[c].tolist() for c in (TIME, "first", "last", "known")), strict=True):
                if before is not None and before[2]:
                    change = first - before[1]
                    grown = first if change < 0 else change
                    out.append((*key, time, grown / ((time - before[0]) / 1e9), known))
                before = (time, last, known)
            self.last.update(before)
            if ttl_ms is not None:
                self.handle.registerTimer(before[0] // 10**6 + ttl_ms)
            # NaN would come back as a missing value.
            steps = pd.DataFrame(out, columns=[*SERIES, TIME, "value", "known"])
            yield steps.assign(nan=steps["value"].isna(), value=steps["value"].fillna(0.0))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            before = self.last.get()
            if before is not None and before[0] // 10**6 + ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Steps()


class Ending:
    """A folder that tells streams of series points that no more will come.

    Run the stream until all of its points are read, ``close`` it and run it again from its checkpoint: the watermark
    then passes every point.  The end is a point of a series of its own, which has no rate.
    """

    # Seconds before the last nanosecond of 64 bits, so that a delay can still be taken from it.
    _TIME = 2**63 - 1 - 10**9
    _SCHEMA = f"service_name string, attributes string, {TIME} bigint, value double"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._write([])

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self._SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def after(self, series: DataFrame) -> DataFrame:
        """The points of a stream, and the end once there is one."""
        ends = self.spark.readStream.schema(self._SCHEMA).parquet(self.folder)
        return series.select(*ends.columns).unionByName(ends)

    def close(self) -> None:
        # Attributes are JSON objects, so no series has this name.
        self._write([("", "end of the stream", self._TIME, 0.0)])


def live_rate(series: DataFrame, delay: str = "1 minute", ttl_seconds: float | None = None) -> DataFrame:
    """Counter rates of a stream of points, as ``operators.metrics.rate`` gives them for a table.

    Points may come up to ``delay`` late and in any order: those of equal time are merged first, however they are
    split over batches, and a time takes part once the watermark has passed it.  A series then only keeps its last
    moment as state.  ``ttl_seconds`` forgets a series when the watermark is that far past its last point.
    """
    timed = with_event_time(series.select(*SERIES, TIME, "value"), delay)
    # Missing values are told by a flag: Pandas would take them for NaN.
    least, most = (F.coalesce(f("value"), F.lit(0.0)) for f in (F.min, F.max))
    moments = timed.groupBy(*SERIES, TIME, EVENT_TIME).agg(least.alias("first"), most.alias("last"), (F.count("value") > 0).alias("known"))
    ttl_ms = None if ttl_seconds is None else int(ttl_seconds * 1000)
    columns = f"service_name string, attributes string, {TIME} bigint, value double, known boolean, nan boolean"
    steps = moments.groupBy(*SERIES).transformWithStateInPandas(_steps(ttl_ms), columns, "Append", "EventTime")
    value = F.when(F.col("known"), F.when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("value")))
    return steps.select(*SERIES, TIME, value.alias("value"))
