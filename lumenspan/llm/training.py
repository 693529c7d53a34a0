"""Bounded labelled samples for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import remainder


def learnable(doc_id: Column, divisor: int, held_out: int) -> Column:
    """Whether the row's label may be learnt from."""
    return remainder(doc_id, divisor) != held_out


def sampled(rows: DataFrame, classes: Column, limit: int, doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """(doc_id, class) of at most ``limit`` distinct ids of each class, those with the least hashes.

    Classes must be few and known: the result is bounded and may be broadcast.
    """
    narrow = rows.select(F.col(doc_id).alias("doc_id"), classes.alias("class")).where("doc_id is not null and class is not null")
    parts = [
        narrow.where(F.col("class") == c).select("doc_id").distinct().withColumn("class", F.lit(c))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)
        for c in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Intercept and weights of a logistic regression by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) / len(y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
