"""Telemetry analytics as PySpark DataFrame functions.

Spans, log records and metric points are three flat DataFrames (see :mod:`lumenspan.schema`); every
operator takes and returns DataFrames or Columns.
"""

from lumenspan.session import configure

__all__ = ["configure"]
