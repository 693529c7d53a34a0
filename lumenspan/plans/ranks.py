"""Exact order statistics without sorting a whole group in one task.

A group (a service, a whole table) may hold any share of the rows.  Values are first counted per
logarithmic band; the running count over the bands tells which band holds each wanted rank, and only
those bands are counted value by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A band spans a thousandth of its values; 63-bit values fall into fewer than 44 000 bands.
BANDS_PER_E = 1000
# Above this many wanted bands the runtime filter no longer pays.
FILTER_LIMIT = 512


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality that also joins NULL keys."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def nearest_ranks(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Per group the value at index ``round((n - 1) * p)`` of the sorted, non-negative whole values.

    Returns the keys and one column per name in ``probabilities``.
    """

    def index(total: Column, p: float) -> Column:
        return F.round((total - 1) * F.lit(p)).cast("bigint")

    return at_ranks(df, keys, value, {name: lambda n, p=p: index(n, p) for name, p in probabilities.items()})


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict) -> DataFrame:
    """Values at zero-based ranks; each rank is a function of the group's row count."""
    band = F.floor(F.log(F.col(value).cast("double") + 1) * BANDS_PER_E).cast("int")
    data = df.select(*keys, F.col(value).alias("__value"), band.alias("__band"))
    data = data.filter(F.col("__value").isNotNull())

    bands = data.groupBy(*keys, "__band").agg(F.count("*").alias("__n"))
    group = W.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("__band").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("__n").over(group)
    located = bands.select(*keys, "__band", upto.alias("__upto"), (upto - F.col("__n")).alias("__before"), total.alias("__total"))
    wanted = F.array(*(F.struct(F.lit(n).alias("name"), f(F.col("__total")).alias("rank")) for n, f in ranks.items()))
    inside = F.filter(wanted, lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__upto")))
    offsets = F.transform(inside, lambda r: F.struct(r["name"].alias("name"), (r["rank"] - F.col("__before")).alias("rank")))
    targets = located.select(*keys, "__band", offsets.alias("__wanted")).filter(F.size("__wanted") > 0)

    # Rows outside every wanted band are dropped before the shuffle; the set is bounded by FILTER_LIMIT.
    band_set = targets.agg(F.collect_set("__band")).scalar()
    kept = data.filter((F.size(band_set) > FILTER_LIMIT) | F.array_contains(band_set, F.col("__band")))
    counted = kept.groupBy(*keys, "__band", "__value").agg(F.count("*").alias("__c"))
    found = counted.join(targets, _same(counted, targets, [*keys, "__band"])).select(
        *(counted[c] for c in [*keys, "__band", "__value", "__c"]), "__wanted"
    )
    running = F.sum("__c").over(
        W.partitionBy(*keys, "__band").orderBy("__value").rowsBetween(W.unboundedPreceding, 0)
    )
    found = found.withColumn("__upto", running)
    hit = F.filter(
        "__wanted", lambda r: (r["rank"] >= F.col("__upto") - F.col("__c")) & (r["rank"] < F.col("__upto"))
    )
    hits = found.select(*keys, "__value", F.explode(hit).alias("__hit"))
    picks = [F.max(F.when(F.col("__hit.name") == name, F.col("__value"))).alias(name) for name in ranks]
    return hits.groupBy(*keys).agg(*picks)
