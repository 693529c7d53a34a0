"""Neighbour and position computations over ordered groups of any size.

A window over a whole group would put a hot group into one task.  Time is cut into slices that hold
about equally many distinct times, however bunched they are; neighbours and positions are computed
inside (group, slice), and what crosses a border travels through one small row per group and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.plans.checkpoints import stored

SLICES = 1024
# Distinct times looked at per slice to place the cuts.
SAMPLE_PER_SLICE = 16
# Cuts are searched in blocks: first the block, then inside it.
BLOCK = 32
HASH_RANGE = 2**31


def _cuts(df: DataFrame, time: str) -> Column:
    """Scalar subquery with the cut times and the last cut of every block.

    The sample is chosen by a hash of the time and a distinct count that does not depend on the order
    of rows, so every evaluation finds the same cuts.  It holds about SLICES * SAMPLE_PER_SLICE times.
    """
    distinct = df.agg(F.approx_count_distinct(time)).scalar()
    drawn = F.pmod(F.xxhash64(time), F.lit(HASH_RANGE)) * distinct < F.lit(HASH_RANGE) * SLICES * SAMPLE_PER_SLICE
    sample = df.filter(drawn).select(time).distinct().agg(F.array_sort(F.collect_list(time)).alias("times"))
    step = F.greatest(F.floor(F.size("times") / SLICES), F.lit(1))
    cuts = sample.select(F.filter("times", lambda x, i: i % step == step - 1).alias("cuts"))
    blocks = F.filter("cuts", lambda x, i: i % BLOCK == BLOCK - 1)
    return cuts.select(F.struct("cuts", blocks.alias("blocks")).alias("c")).scalar()


def with_slice(df: DataFrame, time: str, source: DataFrame) -> DataFrame:
    """Add ``__slice``, the number of cuts up to the row's time; ``source`` has the times to cut."""
    # Held in one column, so that the plan contains the subquery once.
    held = df.withColumn("__cuts", _cuts(source, time))
    upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col(time)))
    first = upto(F.col("__cuts.blocks")) * BLOCK
    held = held.withColumn("__first", first)
    inside = upto(F.slice(F.col("__cuts.cuts"), F.col("__first") + 1, F.lit(BLOCK)))
    # Never NULL, and declared so: a join would otherwise test the search below the aggregation again.
    return held.withColumn("__slice", F.coalesce(F.col("__first") + inside, F.lit(0))).drop("__cuts", "__first")


def with_previous(
    df: DataFrame, keys: list[str], time: str, carried: str, source: DataFrame | None = None
) -> DataFrame:
    """Add ``previous_time`` and ``previous`` (the ``carried`` value) of the row before in each group.

    Times are distinct within a group.  ``source`` has the times to slice by; without it no group is
    larger than one task can sort.
    """
    entry = F.struct(F.col(time).alias("time"), F.col(carried).alias("value"))
    if source is None:
        placed = df.withColumn("__before", F.lag(entry).over(W.partitionBy(*keys).orderBy(time)))
    else:
        sliced = with_slice(df, time, source)
        last = sliced.groupBy(*keys, "__slice").agg(F.max(entry).alias("__last"))
        carry = F.lag("__last").over(W.partitionBy(*keys).orderBy("__slice"))
        borders = last.select(*keys, "__slice", carry.alias("__carry"))
        inside = F.lag(entry).over(W.partitionBy(*keys, "__slice").orderBy(time))
        joined = sliced.withColumn("__inside", inside).join(borders, [*keys, "__slice"])
        placed = joined.withColumn("__before", F.coalesce("__inside", "__carry"))
    return placed.select(
        *df.columns, F.col("__before.time").alias("previous_time"), F.col("__before.value").alias("previous")
    )


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def every_nth(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows 0, s, 2s, ... of each group ordered by ``order``, with s = ceil(n / limit).

    ``order`` starts with the time and covers every column besides the keys, so equal rows are
    interchangeable: copies are counted before the shuffle and only those that are kept come back.
    """
    copies = with_slice(df.groupBy(*keys, *order).agg(F.count("*").alias("__c")), order[0], df)
    sizes = copies.groupBy(*keys, "__slice").agg(F.sum("__c").alias("__n"))
    group = W.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("__slice").rowsBetween(W.unboundedPreceding, 0))
    offsets = sizes.select(
        *keys, "__slice", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(group).alias("__total")
    )
    running = F.sum("__c").over(
        W.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    )
    placed = copies.withColumn("__upto", running).join(offsets, [*keys, "__slice"])
    stride = F.ceil(F.col("__total") / limit).cast("bigint")
    first = F.col("__before") + F.col("__upto") - F.col("__c")
    # Positions first..first+c-1 hold the copies of this row; count the multiples of the stride among them.
    kept = _div(first + F.col("__c") - 1, stride) - _div(first - 1 + stride, stride) + 1
    repeated = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__kept")))
    return placed.withColumn("__kept", kept).filter("__kept > 0").select(*keys, *order, repeated).drop("col")


def with_next(df: DataFrame, keys: list[str], order: list[str], carried: str, name: str = "next") -> DataFrame:
    """Add the ``carried`` value of the following row of the same group, by ``order``; null after the last.

    The whole order is cut into ranges, each a window of its own, so a group of any size is many ranges; the first
    row of a range travels to the range before it.  The rows are written once.
    """
    whole = [*keys, *order]
    ranged = df.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("__range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    row = F.struct(F.struct(*keys).alias("group"), F.col(carried).alias("value"))
    inside = F.lead(row).over(W.partitionBy("__range").orderBy(*whole))
    firsts = ranged.groupBy("__range").agg(F.min_by(row, F.struct(*whole)).alias("__first"))
    # One row for each range: as many as there were tasks.
    borders = firsts.select("__range", F.lead("__first").over(W.orderBy("__range")).alias("__border"))
    placed = ranged.withColumn("__inside", inside).join(borders, "__range")
    after = F.coalesce("__inside", "__border")
    return placed.select(*df.columns, F.when(after["group"] == F.struct(*keys), after["value"]).alias(name))
