"""Ranked lexical search the other way round: documents stream through an index over the queries.

The queries (items) are few against the documents, so the inverted index is built over *their* terms and sent to
every task.  A document's term counts go through it once and add to one score per item; a task keeps the best k
documents of each item so far, and the tasks' heaps are merged at the end.  No document is shuffled and no index
over the documents exists.

The index holds at most ``block_terms`` different (item, term) entries; more items are searched block by block,
each block with two passes over the documents: one for the document frequencies of its terms, one for scores.

Scores are BM25 in whole numbers, as ``weight`` and ``impact`` state; all divisions round down.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenspan.llm.base import APART, LOWER, pieces, stored

#: Bytes with A-Z lower-cased and everything that is not part of a term turned into a space.
_TABLE = bytes(0x20 if APART[i] else int(LOWER[i]) for i in range(256))
BLOCK_TERMS = 1 << 20
#: Scores held at a time, documents times items.
CELLS = 1 << 21
#: Heaps are merged in two rounds, first within so many shares of the tasks.
SHARES = 256


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _postings(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_key, item_id, term, times): each distinct item's different terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = Counter(terms(batch.column(2)[row].as_py()))
                n = len(found)
                ids = [pa.concat_arrays([batch.column(c).slice(row, 1)] * n) if n else batch.column(c).slice(row, 0) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item_key", "item_id", "term", "times"]
                )

    once = items.select(F.xxhash64(item_id, text).alias("item_key"), F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    kind = once.schema["item_id"].dataType.simpleString()
    return once.mapInArrow(count, f"item_key bigint, item_id {kind}, term binary, times bigint")


class Index:
    """Postings of a block of items: per term the items that hold it and how often."""

    def __init__(self, keys: np.ndarray, words: list[bytes], times: np.ndarray):
        self.items, item = np.unique(keys, return_inverse=True)
        self.vocabulary = {w: i for i, w in enumerate(sorted(set(words)))}
        term = np.array([self.vocabulary[w] for w in words], np.int64)
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order].astype(np.int64), times[order].astype(np.int64)
        self.start = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.n_docs = self.n_terms = 0


def _statistics(docs: DataFrame, index: Index) -> DataFrame:
    """(term, n): documents that hold each term of the index; -1: documents with a term, -2: all their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, holds = shared.value, Counter()
        known = vocabulary.keys()
        for batch in batches:
            for text in batch.column(0):
                words = terms(text.as_py())
                holds[-1] += bool(words)
                holds[-2] += len(words)
                holds.update(vocabulary[w] for w in known & set(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(holds), pa.int64()), pa.array(list(holds.values()), pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def weight(holds: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))), in doubles."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * holds + 1))).astype(np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of a term that occurs tf times in a document of length factor m (100: average)."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _best(heap: pa.Table, k: int) -> pa.Table:
    """The k highest scores of each item, equal scores by ascending id, null ids last."""
    heap = heap.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
    item = heap["item"].to_numpy()
    first = np.searchsorted(item, item, side="left")
    return heap.filter(pa.array(np.arange(len(item)) - first < k))


def _scored(docs: DataFrame, index: Index, k: int) -> DataFrame:
    """(item_key, doc_id, score): the best k documents of each item, of each task."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = shared.value
        known, n_items = own.vocabulary.keys(), len(own.items)
        heap, floor = None, np.ones(n_items, np.int64)
        step = max(1, CELLS // max(1, n_items))
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, step):
                part = texts.slice(start, step)
                scores = np.zeros((len(part), n_items), np.int64)
                for row, text in enumerate(part):
                    words = terms(text.as_py())
                    found = Counter(words)
                    hit = sorted(own.vocabulary[w] for w in known & found.keys())
                    if not hit:
                        continue
                    counts = {own.vocabulary[w]: found[w] for w in known & found.keys()}
                    tf = np.array([counts[t] for t in hit], np.int64)
                    hit = np.array(hit)
                    m = 100 - 75 + (75 * len(words) * own.n_docs) // own.n_terms
                    gain = own.weight[hit] * impact(tf, np.int64(m))
                    sizes = own.start[hit + 1] - own.start[hit]
                    at = np.repeat(own.start[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    np.add.at(scores[row], own.item[at], np.repeat(gain, sizes) * own.times[at])
                row, item = np.nonzero(scores >= floor)
                if len(row):
                    ids = batch.column(0).slice(start, step).take(pa.array(row))
                    new = pa.table({"item": item, "score": scores[row, item], "doc_id": ids})
                    heap = _best(new if heap is None else pa.concat_tables([heap, new]), k)
                    full = np.bincount(heap["item"].to_numpy(), minlength=n_items) == k
                    lowest = np.full(n_items, np.iinfo(np.int64).max)
                    np.minimum.at(lowest, heap["item"].to_numpy(), heap["score"].to_numpy())
                    floor = np.where(full, lowest, 1)
        if heap is not None:
            keys = pa.array(own.items[heap["item"].to_numpy()], pa.int64())
            out = pa.table({"item_key": keys, "doc_id": heap["doc_id"], "score": heap["score"]})
            yield from out.combine_chunks().to_batches()

    return docs.mapInArrow(search, f"item_key bigint, doc_id {kind}, score bigint")


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    Items that repeat an id are told apart by their text and ranked each on its own; rows repeated as a whole are
    one item.  Documents that repeat an id, or are repeated as a whole, are ranked each on its own.  Equal scores
    go by ascending doc_id, null ids last.  Null and empty texts have no terms: such an item has no rows, such a
    document is never found and not counted in N.  An empty table on either side gives no rows.  Further columns
    are not read.  An item whose terms alone exceed ``block_terms`` makes a block of its own size.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    postings = stored(_postings(items, f"`{item_id}`", f"`{item_text}`"), "postings")
    blocks = -(-postings.count() // block_terms)
    spark, found = docs.sparkSession, None
    for block in range(blocks):
        held = postings.where(F.pmod("item_key", F.lit(blocks)) == block).select("item_key", "term", "times").toArrow()
        if not held.num_rows:
            continue
        index = Index(held["item_key"].to_numpy(), held["term"].to_pylist(), held["times"].to_numpy())
        known = {r.term: r.n for r in _statistics(narrow, index).collect()}
        index.n_docs, index.n_terms = known.get(-1, 0), known.get(-2, 0)
        if not index.n_docs:
            break
        index.weight = weight(np.array([known.get(i, 0) for i in range(len(index.vocabulary))], np.int64), index.n_docs)
        heaps = _scored(narrow, index, k)
        found = heaps if found is None else found.unionByName(heaps)
    ids = postings.select("item_key", "item_id").distinct()
    if found is None:
        found = spark.createDataFrame([], f"item_key bigint, doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = Window.partitionBy("item_key", "share").orderBy(*order)
    near = found.withColumn("share", F.spark_partition_id() % SHARES).withColumn("place", F.row_number().over(share)).where(F.col("place") <= k)
    whole = Window.partitionBy("item_key").orderBy(*order)
    best = near.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return best.join(ids, "item_key").select("item_id", "rank", "doc_id", "score")
