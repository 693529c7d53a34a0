"""Queries over the test tables with their independent SQL."""

from lumenspan.registry import exchange, logs, metrics, services, traces  # noqa: F401
from lumenspan.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
