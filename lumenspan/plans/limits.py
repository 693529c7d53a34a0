"""How many rows a caller asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def at_least(name: str, value: int, least: int = 1) -> int:
    """The number itself; anything below the least is an error."""
    if value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")
    return value


def first_rows(df: DataFrame, n: int | None, default: int) -> DataFrame:
    """The first n rows of an ordered table: None means all, 0 the default."""
    return df if n is None else df.limit(at_least("the number of rows", n, 0) or default)
