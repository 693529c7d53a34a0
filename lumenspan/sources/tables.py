"""Stored tables and mappings from existing tables to the three schemas."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspan.schema import DEFAULTS, LOGS, POINTS, SPANS, time_column
from lumenspan.sources.retention import PART, PARTITION, Retention, Store

SPANS_DIR, LOGS_DIR, POINTS_DIR = "spans", "logs", "metric_points"


class Telemetry(NamedTuple):
    spans: DataFrame
    logs: DataFrame
    points: DataFrame


def stored_schema(signal: str) -> T.StructType:
    """Schema of a stored table, with its date partition."""
    fields = {SPANS_DIR: SPANS, LOGS_DIR: LOGS, POINTS_DIR: POINTS}[signal].fields
    return T.StructType([*fields, T.StructField(PARTITION, T.DateType())])


def read_parts(spark: SparkSession, folder: str, signal: str, kept: Retention | None = None) -> DataFrame:
    """A stored table with the names of its parts, without what sweeps have removed."""
    schema = T.StructType([*stored_schema(signal).fields, T.StructField(PART, T.StringType())])
    kept = Store(spark, folder).retention() if kept is None else kept
    return kept.live(spark.read.schema(schema).parquet(folder), time_column(schema.fieldNames()))


def read_table(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """One stored table below a folder."""
    return read_parts(spark, f"{path}/{signal}", signal).drop(PART)


def read_tables(spark: SparkSession, path: str) -> Telemetry:
    """Open the three stored tables below a folder."""
    return Telemetry(*(read_table(spark, path, signal) for signal in (SPANS_DIR, LOGS_DIR, POINTS_DIR)))


def _default(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.ArrayType):
        return F.array()
    return F.lit(DEFAULTS.get(field.name, "" if isinstance(field.dataType, T.StringType) else 0))


def _conform(df: DataFrame, schema: T.StructType, mapping: dict[str, Column | str]) -> DataFrame:
    unknown = set(mapping) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")

    def expression(field: T.StructField) -> Column:
        given = mapping.get(field.name)
        value = _default(field) if given is None else F.col(given) if isinstance(given, str) else given
        return value.cast(field.dataType).alias(field.name)

    return df.select(*(expression(field) for field in schema.fields))


def spans_from_table(df: DataFrame, mapping: dict[str, Column | str]) -> DataFrame:
    """Spans from any table; the duration is derived and never negative."""
    spans = _conform(df, SPANS, {k: v for k, v in mapping.items() if k != "duration_nanos"})
    start, end = F.col("start_time_unix_nano"), F.col("end_time_unix_nano")
    return spans.withColumn("duration_nanos", F.greatest(end - start, F.lit(0).cast("bigint")))


def logs_from_table(df: DataFrame, mapping: dict[str, Column | str]) -> DataFrame:
    return _conform(df, LOGS, mapping)


def points_from_table(df: DataFrame, mapping: dict[str, Column | str]) -> DataFrame:
    return _conform(df, POINTS, mapping)
