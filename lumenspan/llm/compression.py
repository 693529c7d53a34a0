"""A quality classifier from compression with zstandard dictionaries.

One dictionary is built from good and one from bad labelled text.  A document is cut into blocks that are
compressed with either; the difference of the two sizes over their sum tells which kind of text it resembles.
Text that repeats itself is small under both, so the sizes over the raw size are kept as a second figure.  A
logistic curve fitted on other labelled documents turns both into a probability of being good.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.base import fresh, stored
from lumenspan.llm.training import fit_logistic, sampled


#: Bytes added to the sum of sizes: short texts lean less.
DAMPING = 64


@dataclass(frozen=True)
class Model:
    """Raw dictionaries, the curve and how to compress; small enough to travel with a task."""

    good: bytes
    bad: bytes
    curve: tuple[float, float, float]
    level: int = 3
    block: int = 512
    _open: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_open"} | {"_open": {}}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not self._open:
            for name in ("good", "bad"):
                content = zstandard.ZstdCompressionDict(getattr(self, name))
                content.precompute_compress(level=self.level)
                self._open[name] = zstandard.ZstdCompressor(dict_data=content, level=self.level, write_content_size=False, write_dict_id=False)
        return list(self._open.values())

    def figures(self, text: str | None) -> tuple[float, float]:
        """Bytes with the bad dictionary less those with the good one, over their sum, and log of compressed over raw."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0, 0.0
        good, bad = (
            sum(len(c.compress(raw[i : i + self.block])) for i in range(0, len(raw), self.block)) for c in self._compressors()
        )
        return (bad - good) / (bad + good + DAMPING), math.log((good + bad) / 2 / len(raw))

    def score(self, text: str | None) -> float:
        lean, ratio = self.figures(text)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.curve[0] + self.curve[1] * lean + self.curve[2] * ratio))))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the joined samples where there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(samples)[-size:] or b"\n"


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1000, curve_docs: int = 1500,
    window: int = 1024, size: int = 1 << 16, doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Learn from the labelled rows given (leave held-out ones out beforehand).

    At most ``per_class`` documents of either class, and half of what it has, are cut, whole, into stretches of
    ``window`` characters from which the dictionaries are trained; at most ``curve_docs`` more of either class, whole, fit the curve.  Which
    ones, a hash of the id tells; of rows that repeat an id, the text of the least hash is taken.  Null ids and
    labels are not used, null texts are empty.  With one class only, or none, every score is the share of good
    labels (0.5 without labels).
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("mark"))
    ids = sampled(marks, F.col("mark"), per_class + curve_docs)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("content"), "text")).alias("first")
    picked = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "class").agg(first).select("doc_id", "class", "first.text")
    picked = stored(picked, "labelled")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    half = F.ceil(F.count("*").over(Window.partitionBy("class")) / 2)
    picked = picked.withColumn("turn", place <= F.least(F.lit(per_class), half))
    # At most 2 * per_class texts.
    whole = picked.where("turn").select("class", "text").where("text <> ''").collect()
    cut = lambda t: (t[i : i + window] for i in range(0, len(t), window))
    parts = {c: sorted(x.encode("utf-8", "surrogatepass") for r in whole if r["class"] == c for x in cut(r["text"])) for c in (0, 1)}
    good, bad = dictionary(parts[1], size), dictionary(parts[0], size)
    measured = with_figures(picked.where("not turn"), Model(good, bad, (0.0, 0.0, 0.0)), "figures", "text")
    measured = measured.select("doc_id", "class", "figures").orderBy("doc_id", "figures").collect()  # at most 2 * curve_docs pairs
    x = np.array([tuple(r["figures"]) for r in measured], float).reshape(-1, 2)
    y = np.array([r["class"] for r in measured], float)
    if parts[0] and parts[1] and 0 < y.sum() < len(y):
        spread = np.where(x.std(0) > 0, x.std(0), 1.0)
        a, b, c = fit_logistic(x / spread, y)
        return Model(good, bad, (float(a), float(b / spread[0]), float(c / spread[1])))
    share = marks.agg(F.avg(F.col("mark").cast("double"))).first()[0]
    share = min(max(0.5 if share is None else share, 1e-6), 1 - 1e-6)
    return Model(good, bad, (math.log(share / (1 - share)), 0.0, 0.0))


def with_figures(docs: DataFrame, model: Model, name: str = "figures", text: str = "text") -> DataFrame:
    """The documents with the two figures of Model.figures as a struct."""

    @F.pandas_udf("lean double, ratio double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model.figures(t) for t in batch], columns=["lean", "ratio"])

    return docs.withColumn(fresh(docs, name), measure.asNondeterministic()(F.col(f"`{text}`")))


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """The documents with a probability of being good; null and empty texts get the curve's value at 0.

    Equal texts get equal scores, ids are not looked at, an empty table stays empty.  All columns are carried along;
    the new one gets underscores before its name while the documents have such a column.
    """

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype=float)

    return docs.withColumn(fresh(docs, name), rate.asNondeterministic()(F.col(f"`{text}`")))
