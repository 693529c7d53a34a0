"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output divided by its share of the input.  How
often a document appears is the inverse of the Poisson distribution with that mean at a uniform number that
is a hash of seed and id: 0 leaves it out, 2 and more repeat it.  The copies are ordered by another hash,
which shuffles them globally.  Nothing depends on partitions or on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import fresh, looked_up, stored

#: exp(-rate) must stay a normal number: larger rates are sums of independent counts.
RATE_STEP = 500.0
#: Sources whose distributions may be broadcast: at the usual rates about a kilobyte each.
BROADCAST_SOURCES = 20_000
DIGITS = 13


def uniform_bits(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, joined with colons; null counts as the empty text."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("bigint")


def rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, size: float, source: str) -> DataFrame:
    """(source, rate): expected copies of one document of each source.

    Weights name target shares by source, a source without one is left out; without weights, shares follow
    the input's counts to the power of ``temperature``.  ``size`` is the expected output over the input.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        if any(not w >= 0 for w in weights.values()):
            raise ValueError("weights must be numbers of at least 0")
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    weighed = stored(counts.select("source", "n", weight.alias("weight")), "rates")
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    share = F.lit(0.0) if not total["weight"] else F.col("weight") / F.lit(total["weight"])
    return weighed.select("source", (share * F.lit(float(total["n"] or 0) * size) / F.col("n")).alias("rate"))


def _distribution(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where doubles reach 1."""
    most = F.ceil(rate + F.sqrt(rate) * 12 + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        total = state["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.array_append(state["all"], total).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda state: state["all"])


def _key(source: Column) -> Column:
    """A text that tells every source, and null, apart."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 17,
    source: str = "source", doc_id: str = "doc_id", replica: str = "replica", order: str = "shuffle_key",
) -> DataFrame:
    """Copies of the documents in shuffled order: their columns, the copy's number (from 0) and its sort key.

    Null sources are a source of their own, which only the weight None can name.  Rows with equal ids get
    equal counts.  Texts are carried along whole, null ones too.  An empty table stays empty.  The
    added columns get underscores before their names while the documents have such a column.
    """
    replica, order, key, odds, times = (fresh(docs, c) for c in (replica, order, "mix_source", "mix_odds", "times"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    table = rates(docs, weights, temperature, size, source).where("rate > 0")
    parts = F.greatest(F.ceil(F.col("rate") / RATE_STEP), F.lit(1)).cast("int")
    table = table.select(_key(F.col("source")).alias(key), parts.alias("parts"), (F.col("rate") / parts).alias("part"))
    table = stored(table.select(key, F.struct("parts", _distribution(F.col("part")).alias("upto")).alias(odds)), "distributions")
    keyed = docs.withColumn(key, _key(F.col(f"`{source}`")))
    few = table.count() <= BROADCAST_SOURCES
    joined = keyed.join(F.broadcast(table), key) if few else looked_up(keyed, table, key, "inner")
    uniform = lambda part: uniform_bits(F.lit(seed), F.col(f"`{doc_id}`"), part) / F.lit(float(16**DIGITS))
    draws = F.transform(F.sequence(F.lit(1), F.col(f"{odds}.parts")), uniform)
    below = lambda u: F.size(F.filter(F.col(f"{odds}.upto"), lambda c: c <= u))
    count = F.aggregate(draws, F.lit(0), lambda a, u: a + below(u))
    counted = joined.select(*own, count.alias(times)).where(F.col(times) > 0)
    copies = counted.select(*own, F.explode(F.sequence(F.lit(0), F.col(times) - 1)).alias(replica))
    again = uniform_bits(F.lit(seed), F.col(f"`{doc_id}`"), F.col(replica), F.lit("order"))
    return copies.withColumn(order, again).orderBy(order, f"`{doc_id}`", replica)
