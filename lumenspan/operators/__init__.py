"""Trace, log, metric, service, field and correlation operators: DataFrames in, DataFrames out."""
