"""Attribute keys and their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.functions.filters import on_dates
from lumenspan.operators import traces

MAX_FIELDS = 50
TOP_VALUES = 5
# Fields of a report are broadcast up to this many rows.
BROADCAST_FIELDS = 1000


def _entries(document: Column, prefix: Column | None = None) -> Column:
    """Members of a JSON object: name, text (raw for strings) and whether the value is an object.

    Member texts come from a string map, which keeps number texts.  A string that looks like an object
    needs ``"{`` (or an escape) in the document; only such documents are parsed again as VARIANT to tell
    the two apart.
    """
    texts = F.map_entries(F.from_json(document, "map<string,string>"))
    ambiguous = document.contains('"{') | document.contains("\\u007")

    def entry(e: Column) -> Column:
        kinds = F.from_json(document, "map<string,variant>")
        kind = F.schema_of_variant(F.try_element_at(kinds, e["key"]))
        return F.struct(
            (e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])).alias("name"),
            F.coalesce(e["value"], F.lit("null")).alias("value"),
            F.coalesce(
                F.when(e["value"].startswith("{"), F.when(ambiguous, kind.startswith("OBJECT")).otherwise(True)),
                F.lit(False),
            ).alias("nested"),
        )

    return F.coalesce(F.transform(texts, entry), F.expr("array()"))


def flatten_json(df: DataFrame, document: str, keep: Sequence[str] = ()) -> DataFrame:
    """(name, value) of every leaf of a JSON object column of any depth, names dotted; empty objects give nothing."""
    nested = lambda e: e["nested"]

    def opened(entries: Column) -> Column:
        return F.flatten(F.transform(entries, lambda e: F.when(e["nested"], _entries(e["value"], e["name"])).otherwise(F.array(e))))

    # One turn for each object inside the row's own document, which is more than its levels; a turn that finds no
    # object leaves the entries as they are.
    inner = F.greatest(F.regexp_count(F.col(document), F.lit("\\{")) - 1, F.lit(0))
    turns = F.array_repeat(F.lit(0), F.coalesce(inner, F.lit(0)))
    leaves = F.aggregate(turns, _entries(F.col(document)), lambda s, _: F.when(F.exists(s, nested), opened(s)).otherwise(s))
    rows = df.select(*keep, leaves.alias("__e"))
    # The outer form keeps the optimizer from copying the nested expression into a non-empty filter.
    return rows.select(*keep, F.inline_outer("__e")).filter(F.col("name").isNotNull()).select(*keep, "name", "value")


def attribute_observations(df: DataFrame) -> DataFrame:
    """(name, value, n) over attributes and resource attributes.

    Resources repeat on every row they sent; each distinct one is flattened once.
    """
    own = flatten_json(df, "attributes").withColumn("n", F.lit(1).cast("bigint"))
    resources = df.groupBy("resource_attributes").agg(F.count("*").alias("n"))
    return own.unionByName(flatten_json(resources, "resource_attributes", ["n"]).select("name", "value", "n"))


def rank_fields(
    observations: DataFrame, fields: int = MAX_FIELDS, values: int = TOP_VALUES, characters: int | None = None
) -> DataFrame:
    """Most frequent names with their most frequent values.

    Whole values are counted; with ``characters``, values that begin alike are counted as one.  Observations are (name, value) rows; a column ``n`` says how often each row was seen.
    """
    times = F.sum("n") if "n" in observations.columns else F.count("*")
    cut = (F.col("value") if characters is None else F.substring("value", 1, characters)).alias("value")
    counted = (
        observations.filter(F.col("name") != "").groupBy("name", cut).agg(times.alias("n"))
    )
    totals = counted.groupBy("name").agg(F.sum("n").alias("count"))
    top = totals.orderBy(F.desc("count"), "name").limit(fields)
    # An inner join with unique names, not a semi join: the optimizer would move a semi join below the
    # aggregation and count everything a second time instead of reusing its shuffle.
    small = F.broadcast(top) if fields <= BROADCAST_FIELDS else top
    # The values of one name may be nearly all distinct: the rank filter also runs before the shuffle.
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "value"))
    best = counted.join(small, "name").withColumn("__rank", rank).filter(F.col("__rank") <= values)
    entry = F.struct("__rank", F.struct("value", F.col("n").alias("count")).alias("top"))
    listed = best.groupBy("name", "count").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["top"]).alias("top_values")
    )
    return listed.orderBy(F.desc("count"), "name")


def trace_fields(
    spans: DataFrame, fields: int = MAX_FIELDS, sample_traces: int | None = None, **filters
) -> DataFrame:
    """Attribute keys of the traces that have a span passing the filters.

    All such traces are read; ``sample_traces`` looks at the newest k only.
    """
    if sample_traces is not None:
        ids = traces.candidate_traces(spans, sample_traces, **filters)
        spans = traces.spans_of(spans, ids, sample_traces)
    elif any(value not in (None, "", False) for value in filters.values()):
        ids = on_dates(spans, **filters).filter(traces.span_filter(**filters)).select("trace_id").distinct()
        spans = spans.join(ids, "trace_id", "left_semi")
    return rank_fields(attribute_observations(spans), fields)
