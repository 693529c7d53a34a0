"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled set is drawn from all text, as the estimator
assumes, so that toxic documents are in it at the rate of the class prior.  A linear model over the presence
of words is trained in numpy on the risk

    prior * E+[loss(f, +1)] + max(0, Eu[loss(f, -1)] - prior * E+[loss(f, -1)]),

whose second part, the corrected risk of the negatives, is kept from falling below zero: where it would, the
step is taken in the opposite direction of that part.  The class prior is a parameter or, by default, the
toxic share of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import APART, fresh, joined, pieces, stored, word_hashes
from lumenspan.llm.training import sampled


def distinct_words(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the different words of each text; words are runs of letters and digits."""
    for start, end in pieces(texts):
        data, begins = joined(texts[start:end])
        places, hashes = word_hashes(data, APART)
        for own in np.split(hashes, np.searchsorted(places, begins[1:])):
            yield np.unique(own)


@dataclass(frozen=True)
class Model:
    """Weights by word hash (sorted) and an intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> list[float]:
        return [1 / (1 + float(np.exp(-np.clip(self._sum(own), -30, 30)))) for own in distinct_words(texts)]

    def _sum(self, own: np.ndarray) -> float:
        if not len(self.words):
            return self.intercept
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        return self.intercept + float(self.weights[at[self.words[at] == own]].sum())


def _vocabulary(rows: DataFrame, n: int, m: int, size: int, min_docs: int, min_z: float = 4.5) -> np.ndarray:
    """The words that are at least twice as common, and surely commoner, among the n positives than among the m others.

    ``rows`` have class and ``words``, the different words of a document.  Best z values come first; at most
    ``size`` words leave Spark.
    """
    each = rows.select("class", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.sum("class").cast("double").alias("p"), F.sum(1 - F.col("class")).cast("double").alias("u"))
    p, u, both = F.col("p"), F.col("u"), (F.col("p") + F.col("u")) / (n + m)
    z = (p / n - u / m) / F.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-12)
    sure = (p >= min_docs) & (z >= min_z) & ((p + 1) / n >= 2 * (u / m + 1 / n))
    unsigned = F.col("word").bitwiseXOR(F.lit(-(1 << 63)))
    best = counts.select("word", z.alias("z"), sure.alias("sure")).where("sure").orderBy(F.desc("z"), unsigned).limit(size)
    return np.sort(np.array([r["word"] for r in best.collect()], np.int64).view(np.uint64))


def _matrices(rows: DataFrame, words: np.ndarray) -> list[np.ndarray]:
    """Presence of the words in the documents of class 1 and of class 0: a bit per word leaves Spark."""

    @F.pandas_udf("binary")
    def bits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.packbits(np.isin(words, np.asarray(own, np.int64).view(np.uint64), assume_unique=True)).tobytes() for own in batch])

    found = rows.select("class", bits.asNondeterministic()("words").alias("bits")).collect()
    packed = [sorted(bytes(r["bits"]) for r in found if r["class"] == c) for c in (1, 0)]
    unpack = lambda b: np.unpackbits(np.frombuffer(b, np.uint8))[: len(words)]
    return [np.array([unpack(b) for b in own], np.float32).reshape(len(own), len(words)) for own in packed]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 3e-5, epochs: int = 800, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the non-negative risk with the logistic loss."""
    p, u = (np.column_stack([x, np.ones(len(x), np.float32)]).astype(float) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    loss = lambda f: np.logaddexp(0, f)  # noqa: E731  of calling f negative
    for t in range(1, epochs + 1):
        fp, fu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
        toxic = prior * (p.T @ (sp - 1)) / len(p)
        rest = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        negative_risk = loss(fu).mean() - prior * loss(fp).mean()
        gradient = (toxic + rest if negative_risk >= 0 else -rest) + ridge * w * (np.arange(len(w)) < len(w) - 1)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, label: str = "toxic", n_positive: int = 1500,
    n_unlabelled: int = 3000, words: int = 1024, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Learn from the documents and labels given (leave held-out rows out of both beforehand).

    At most ``n_positive`` confirmed ids and ``n_unlabelled`` of all ids are chosen by hash; their documents are
    turned into word hashes, whole.  Of rows that repeat an id, the text of the least hash is taken.  Word counts
    stay in Spark; at most ``words`` words and, per chosen document, a bit for each of them are gathered.
    Null ids and labels are not used, null and empty texts have no words.  Without a confirmed document, or
    without any, the score is 0 for all texts.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("mark"))
    confirmed = sampled(marks.where(F.col("mark") == 1), F.lit(1), n_positive)
    ids = confirmed.unionByName(sampled(own, F.lit(0), n_unlabelled, seed=1))

    @F.pandas_udf("array<bigint>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([own.view(np.int64) for own in distinct_words(list(batch))])

    picked = own.join(F.broadcast(ids), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("content"), "text")).alias("first")
    once = picked.groupBy("doc_id", "class").agg(first).select("class", F.col("first.text").alias("text"))
    rows = stored(once.select("class", hashed.asNondeterministic()(F.col("text")).alias("words")), "words")
    sizes = {r["class"]: r["count"] for r in rows.groupBy("class").count().collect()}
    if prior is None:
        prior = marks.where(F.col("mark").isNotNull()).agg(F.avg((F.col("mark") == 1).cast("double"))).first()[0]
    if len(sizes) < 2 or not prior:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    chosen = _vocabulary(rows, sizes[1], sizes[0], words, min_docs)
    weights, intercept = fit(*_matrices(rows, chosen), prior)
    return Model(chosen, weights, intercept)


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """The documents with a probability of being toxic; null and empty texts have no words and get the intercept's.

    Equal texts get equal scores, ids are not looked at, an empty table stays empty.  All columns are carried along;
    the new one gets underscores before its name while the documents have such a column.
    """

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(list(batch)), dtype=float)

    return docs.withColumn(fresh(docs, name), rate.asNondeterministic()(F.col(f"`{text}`")))
