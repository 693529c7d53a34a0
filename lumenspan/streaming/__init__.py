"""Continuous forms of the operators on Structured Streaming."""

from lumenspan.streaming.live import (
    deduplicated,
    live_rate,
    live_red,
    live_tail,
    live_volume,
    session_traces,
    start_ingest,
    with_event_time,
)

__all__ = [
    "deduplicated",
    "live_rate",
    "live_red",
    "live_tail",
    "live_volume",
    "session_traces",
    "start_ingest",
    "with_event_time",
]
