"""Partitioned Parquet tables: append, retention and size bounds.

A table is a folder of dates, and a date a folder of parts.  Every append and every batch of a stream has a part
of its own, so none of them touches files of another: a repeated batch replaces its own part, and a sweep removes
only what it has counted.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.filters import NANOS_PER_DAY
from lumenspan.plans.ranks import at_ranks
from lumenspan.schema import time_column
from lumenspan.sources.retention import PART, PARTITION, Store, folder_name
from lumenspan.sources.tables import LOGS_DIR, POINTS_DIR, SPANS_DIR, Telemetry, read_parts

# Order inside a partition, for row-group skipping on the usual lookups.
CLUSTERING = {
    SPANS_DIR: ["trace_id", "start_time_unix_nano"],
    LOGS_DIR: ["time_unix_nano"],
    POINTS_DIR: ["name", "time_unix_nano"],
}


def with_date(df: DataFrame) -> DataFrame:
    """Add the partition column derived from the event time."""
    days = F.floor(F.col(time_column(df.columns)) / F.lit(NANOS_PER_DAY)).cast("int")
    return df.withColumn(PARTITION, F.date_from_unix_date(days))


def append(df: DataFrame, path: str, signal: str, records_per_file: int = 5_000_000, part: str | None = None) -> None:
    """Append rows to one of the stored tables; no rows add no partition.

    With the name of a part, its rows of the same dates are replaced: writing a part again changes nothing.

    Rows are split by ranges of (date, clustering columns): a heavy date is shared by many tasks, and
    each task writes few dates.
    """
    order = [PARTITION, *CLUSTERING[signal]]
    if signal == SPANS_DIR:
        start, end = F.col("start_time_unix_nano"), F.col("end_time_unix_nano")
        df = df.withColumn("duration_nanos", F.greatest(end - start, F.lit(0).cast("bigint")))
    rows = with_date(df).repartitionByRange(*order).sortWithinPartitions(*order)
    _write_part(rows, f"{path}/{signal}", part or f"rows-{uuid.uuid4().hex}", records_per_file)


def _write_part(rows: DataFrame, folder: str, part: str, records_per_file: int) -> None:
    writer = rows.withColumn(PART, F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if "trace_id" in rows.columns:
        # Row groups whose range of ids holds one that none of their rows has are skipped, too.
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.partitionBy(PARTITION, PART).option("maxRecordsPerFile", records_per_file).parquet(folder)


def append_all(tables: Telemetry, path: str) -> None:
    for df, signal in zip(tables, (SPANS_DIR, LOGS_DIR, POINTS_DIR)):
        append(df, path, signal)


def retention_cutoff(now_nanos: int, retention_seconds: float) -> int:
    return max(now_nanos - int(retention_seconds * 1e9), 0)


def expired_counts(tables: Telemetry, cutoff: int) -> DataFrame:
    """Per table the rows strictly before the cutoff and the rows that stay."""
    counted = []
    for df, signal in zip(tables, (SPANS_DIR, LOGS_DIR, POINTS_DIR)):
        old = F.col(time_column(df.columns)) < cutoff
        counted.append(
            df.agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept")).select(
                F.lit(signal).alias("signal"), "expired", "kept"
            )
        )
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


class Swept(NamedTuple):
    spans: int
    logs: int
    points: int


def sweep_expired(spark: SparkSession, path: str, cutoff: int) -> Swept:
    """Remove rows strictly before the cutoff from the three stored tables and return how many.

    Rows of dates before that of the cutoff are counted from the files' row counts, those of the cutoff's own date by
    their times.  One small file then tells readers which folders are gone and which are cut at the cutoff; only
    after that are the folders deleted.  A sweep that is cut short before has changed nothing, one that is cut short
    after leaves only folders that nobody reads, which the next sweep deletes.  Rows of a folder that is cut lie in
    its files until the date has passed, unseen.  Rows that arrive meanwhile stay, old ones until the next sweep.
    """
    return Swept(*(_sweep(spark, f"{path}/{signal}", signal, cutoff) for signal in (SPANS_DIR, LOGS_DIR, POINTS_DIR)))


def _sweep(spark: SparkSession, folder: str, signal: str, cutoff: int) -> int:
    store = Store(spark, folder)
    if not store.exists():
        return 0
    kept = store.retention()
    table = read_parts(spark, folder, signal, kept)
    day = F.date_from_unix_date(F.lit(cutoff // NANOS_PER_DAY))
    time = F.col(time_column(table.columns))
    date = F.col(PARTITION).cast("string").alias("day")
    # One row for each part of a date.  Whole dates need no data column, only row counts.
    old = table.filter(F.col(PARTITION) < day).groupBy(date, PART).agg(F.count("*").alias("expired"), F.lit(0).alias("kept"))
    own = table.filter(F.col(PARTITION) == day).groupBy(date, PART)
    own = own.agg(F.count_if(time < cutoff).alias("expired"), F.count_if(time >= cutoff).alias("kept"))
    found = [row for row in old.unionByName(own).collect() if row["expired"]]
    emptied = {folder_name(row["day"], row[PART]) for row in found if not row["kept"]}
    cut = {folder_name(row["day"], row[PART]): cutoff for row in found if row["kept"]}
    gone = kept.gone | emptied
    if found:
        trimmed = {name: at for name, at in (kept.trimmed | cut).items() if name not in gone}
        kept = store.commit(kept, gone, trimmed)
    if gone:
        for name in sorted(gone):
            store.delete(name)
        store.commit(kept, frozenset(), kept.trimmed)
    return sum(row["expired"] for row in found)


def keep_newest(df: DataFrame, n: int) -> DataFrame:
    """The newest n rows.

    The time of the n-th newest row is found by exact rank, so no task sorts n rows; only rows at
    exactly that time are chosen among, by content.
    """
    time = time_column(df.columns)
    if n <= 0:
        return df.limit(0)
    low = df.agg(F.min(time)).scalar()
    shifted = df.select((F.col(time) - low).alias("age"))
    found = at_ranks(shifted, [], "age", {"cut": lambda total: F.greatest(total - n, F.lit(0).cast("bigint"))})
    # Two numbers reach the driver: the cut and the rows above it.
    cut = found.select((F.col("cut") + low).alias("cut")).first()
    if cut is None or cut["cut"] is None:
        return df
    above = df.filter(F.col(time) > cut["cut"])
    ties = df.filter(F.col(time) == cut["cut"]).orderBy(*df.columns).limit(n - above.count())
    return above.unionByName(ties)
