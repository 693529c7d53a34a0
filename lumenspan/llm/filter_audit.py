"""What filters remove alone, in every order and together: forward and backward path counts over subsets.

Filters are applied one after another to documents.  The state after some of them is the set of filters applied
so far, so the orders of n filters are the paths from the empty set to the full one through a lattice of 2^n
states.  What a filter removes next depends on the state only, not on the path to it:

* ``lattice`` counts the paths that reach each state (forward) and that leave it (backward);
* ``edges`` gives, per part of the data, what each edge (state, next filter) removes, from one count per set of
  failed filters;
* ``shapley`` weights an edge's removals with the paths through it, which sums over all orders without walking
  any of them;
* ``steps`` reads the steps of single orders from the same edges.

The documents are read once; everything after the counts has at most 2^n rows per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import BATCH_ROWS, fresh

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#$%&*|"
#: Orders are listed one by one up to this number of filters: 5040 of them.
LISTED = 7


def lattice(n: int) -> dict[int, tuple[int, int]]:
    """Per state (a bit mask of applied filters): orders that reach it from none, and that lead from it to all."""
    states = sorted(range(1 << n), key=int.bit_count)
    reach = {s: 0 for s in states} | {0: 1}
    for s in states:
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    leave = {s: 0 for s in states} | {states[-1]: 1}
    for s in reversed(states):
        for f in range(n):
            if not s >> f & 1:
                leave[s] += leave[s | 1 << f]
    return {s: (reach[s], leave[s]) for s in states}


def edges(counts: DataFrame, names: str, part: str = "part", failed: str = "failed", n: str = "n", also: list[str] = ()) -> DataFrame:
    """One row per part and edge of the lattice: what the filter ``name`` does after those of ``state``.

    ``counts`` has one or more rows per part and bit mask of failed filters (bit i for the i-th name) with their
    number of documents and, named by ``also``, numbers of documents of interest.  Adds: ``paths`` (orders that
    use the edge), ``kept``, ``removed``, ``redundant`` (fail the filter but went before), ``unique_fails`` (fail
    no other filter), and ``<name>_lost`` for each of ``also``.  Every part has all edges, zeros included.
    """
    ways = lattice(len(names))
    all_edges = [
        (s, f, 1 << f, reach * ways[s | 1 << f][1], names[f]) for s, (reach, _) in ways.items() for f in range(len(names)) if not s >> f & 1
    ]
    literal = F.array(
        *(F.struct(*(F.lit(v).alias(k) for k, v in zip(("state", "filter", "bit", "paths", "name"), e, strict=True))) for e in all_edges)
    )
    mask = F.col(failed).cast("int")
    once = counts.groupBy(F.col(part).alias("part"), mask.alias("failed")).agg(F.sum(n).alias("n"), *(F.sum(c).alias(c) for c in also))
    each = once.select("part", "failed", "n", *also, F.explode(literal).alias("e")).select("part", "failed", "n", *also, "e.*")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    gone = F.col("failed").bitwiseAND(F.col("state")) != 0
    total = lambda which, what="n": F.sum(F.when(which, F.col(what)).otherwise(0))
    return each.groupBy("part", "state", "filter", "name", "paths").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        *(total(fails & ~gone, c).alias(f"{c}_lost") for c in also),
    )


def shapley(found: DataFrame) -> DataFrame:
    """(part, name, shapley): removals of the filter summed over all orders, each edge weighted by its paths."""
    return found.groupBy("part", "name").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))


def steps(found: DataFrame, names: str) -> DataFrame:
    """The edges of every order of the filters: adds ``filter_order`` and ``step`` (from 1) to rows of ``edges``."""
    if len(names) > LISTED:
        raise ValueError(f"orders of more than {LISTED} filters are not listed; shapley() needs no list")
    walked = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            walked.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    # n * n! rows, 600 for five filters, whatever the data.
    listed = found.sparkSession.createDataFrame(walked, "filter_order string, step int, state int, filter int")
    return found.join(F.broadcast(listed), ["state", "filter"])


def text_faults(text: str | None) -> int:
    """Bits 0 to 3: under 50 words, repetitive words, many capitals, a symbol."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at ASCII white space
    capitals = len(raw) - len(raw.translate(None, UPPER))
    faults = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), any(c in text for c in SYMBOLS))
    return sum(1 << i for i, fault in enumerate(faults) if fault)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "failed") -> DataFrame:
    """The documents with a bit mask of the five filters A to E that they fail.

    A to D look at the text alone.  E: the text equals that of a smaller id anywhere in the table.  Texts meet by
    a 128-bit digest: the least id per digest is combined before the shuffle and joined back by digest *and* id,
    so that a text of very many copies is no hot key.  A null text counts as empty.  A null id is neither smaller
    nor larger than another; rows that repeat an id are not copies of each other.  All columns are carried along.
    """

    @F.pandas_udf("int")
    def faults(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_faults(t) for t in batch], dtype="int32")

    digest, first = fresh(docs, "digest"), fresh(docs, "first_id")
    whole = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != text]
    # The text goes no further than this projection.
    marked = docs.select(*columns, whole.alias(digest), faults.asNondeterministic()(F.col(text)).alias(fresh(docs, name)))
    firsts = docs.select(whole.alias(digest), F.col(doc_id).alias(first)).groupBy(digest).agg(F.min(first).alias(first))
    firsts = firsts.withColumnRenamed(digest, f"{digest}_of")
    same = (F.col(digest) == F.col(f"{digest}_of")) & (F.col(f"`{doc_id}`") == F.col(first))
    both = marked.join(firsts, same, "left")
    copy = F.col(f"`{doc_id}`").isNotNull() & F.col(first).isNull()
    out = F.col(fresh(docs, name)).bitwiseOR(F.when(copy, F.lit(16)).otherwise(F.lit(0)))
    return both.select(*columns, out.alias(fresh(docs, name)))


NAMES = "ABCDE"


def audit(docs: DataFrame, labels: DataFrame, source: str = "source") -> DataFrame:
    """Steps of all 120 orders of the filters A to E, per source (null: empty text).

    Columns: part, filter_order, step, name, paths, kept, removed, redundant, unique_fails, good_lost, toxic_lost
    (documents whose id has a label row of quality 1, toxic 1) and shapley.  Several label rows of an id count as
    one, documents without a label are neither.  An empty table gives no rows.
    """
    narrow = docs.select("doc_id", "text", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"))
    failed = failures(narrow)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("bigint")
    rows = failed.join(known, F.col("doc_id") == F.col("label_id"), "left")
    counts = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum(flag("good")).alias("good"), F.sum(flag("toxic")).alias("toxic"))
    found = edges(counts, NAMES, also=["good", "toxic"])
    return steps(found.join(shapley(found), ["part", "name"]), NAMES)
