"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits: the majority of the bits of all shingles' XXH64 (seed 42).  Two fingerprints link at
two or fewer differing bits; documents of linked fingerprints form components.

The search keeps one table per segment, a segment being one half of the fingerprint.  Two bits over two segments
leave at most one in either half, or none in one of them: so the second table is asked for the segment itself, the
first one for every value of its Hamming ball of radius one.  What a table holds under a value is fetched and the
complete distances are checked.  A value that more than ``BUCKET`` fingerprints share is not fetched member by
member: there the ball is enumerated in the other segment, too.  All that meet under such a key are within one bit
of it, so within two of each other, and at most 65 different ones can; each is linked to the least of them.  Links
so grow in proportion to the distinct fingerprints whatever they have in common.

Two bits find copies with few changes.  At a similarity of 0.8 about ten bits differ, for which no number of
segments is both whole and selective, so ``keep_one`` widens the search: sets of shingles that share a band of
minima are compared with representatives of the band, never with each other, and link if they share 0.8 of their
union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import fresh, looked_up, mix, stored
from lumenspan.llm.components import components

SEED = 42
CHUNK = 1 << 16
#: Bits of a segment.
HALF = 32
#: Members of a table entry up to which they are fetched one by one.
BUCKET = 8
#: Distinct fingerprints for each task that enumerates their probes.
PER_TASK = 1 << 14
#: Bands of the wider search and minima in each: two sets that share 0.8 miss every band in 4 of 10^8 cases.
BANDS = 56
ROWS = 6
#: Orders in which a band's representative is the least; each band uses one of them.
ORDERS = 8
_FACTORS = np.random.Generator(np.random.PCG64(20240918)).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PART = 1 << 11


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every run of k lower-cased words; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(k))) if len(words) > k else [words]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(run), SEED) for run in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The documents with a signed 64-bit fingerprint; that of a text without words is zero."""

    @F.pandas_udf("bigint")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([majority(shingle_hashes(t, shingle)) for t in batch], dtype="int64")

    return docs.withColumn(fresh(docs, name), fingerprint.asNondeterministic()(F.col(f"`{text}`")))


def _segment(fp: Column, number: int) -> Column:
    """The lower (0) or upper (1) half of the fingerprint, as an unsigned number."""
    return F.call_function("shiftrightunsigned", fp, F.lit(HALF)) if number else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def _flips(number: int) -> Column:
    """Zero and every bit of the segment, in place: what the ball of radius one adds to a fingerprint."""
    bits = (1 << i for i in range(HALF * number, HALF * number + HALF))
    return F.array(*(F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint") for x in (0, *bits)))


def close_links(prints: DataFrame) -> DataFrame:
    """(a, b) at one or two differing bits, enough of them to connect everything connected; prints: distinct ``fp``."""
    fp = F.col("fp")
    entries = [F.struct(F.lit(s).alias("segment"), _segment(fp, s).alias("value")) for s in (0, 1)]
    table = prints.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.*", "fp")
    sizes = table.groupBy("segment", "value").agg(F.count("*").alias("n"))
    # In the first segment the whole ball, in the second one the value itself.
    ball = F.transform(_flips(0), lambda x: F.struct(F.lit(0).alias("segment"), _segment(fp.bitwiseXOR(x), 0).alias("value"), x.alias("flip")))
    own = F.struct(F.lit(1).alias("segment"), _segment(fp, 1).alias("value"), F.lit(0).cast("bigint").alias("flip"))
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() // PER_TASK)
    probes = prints.repartition(tasks).select("fp", F.explode(F.array_append(ball, own)).alias("p")).select("fp", "p.*")
    # Most values of a ball are in no table; a fingerprint alone in its own entry has nothing to fetch.
    hits = probes.join(sizes, ["segment", "value"]).where((F.col("flip") != 0) | (F.col("n") > min(1, BUCKET)))
    hits = stored(hits, "hits")

    fetched = hits.where(F.col("n") <= BUCKET).join(table.withColumnRenamed("fp", "other"), ["segment", "value"])
    fetched = fetched.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))

    # Members of a large entry enumerate the ball of the other segment; a probe from outside stands for its entry's value.
    other = F.when(F.col("segment") == 0, _flips(1)).otherwise(_flips(0))
    around = F.when(F.col("flip") == 0, F.transform(other, lambda x: fp.bitwiseXOR(x))).otherwise(F.array(fp.bitwiseXOR(F.col("flip"))))
    keys = hits.where(F.col("n") > BUCKET).select("fp", F.explode(around).alias("key"))
    met = keys.groupBy("key").agg(F.array_sort(F.collect_set("fp")).alias("members")).where(F.size("members") > 1)
    linked = met.select(F.explode("members").alias("a"), F.col("members")[0].alias("b"))

    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return fetched.unionByName(linked).where((F.col("a") != F.col("b")) & (distance <= 2)).distinct()


def near_components(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: fingerprints link at two or fewer differing bits.

    component_id is the least id that links reach, the row's own included (null where all of them are null).
    Texts that are null or without words have fingerprint zero and link like any other.  Repeated rows stay
    repeated.  An empty table gives an empty result.  Further columns of the documents are not read.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = fingerprints(narrow, shingle).select("doc_id", F.col("fingerprint").alias("fp"))
    rows = stored(marked, "fingerprints")
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(close_links(least.select("fp")))
    members = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    firsts = members.groupBy("root").agg(F.min("least").alias("first"))
    linked = members.join(firsts, "root").select("fp", "first")
    classes = least.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id"))
    return looked_up(rows, stored(classes, "classes"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the band's number and its least scrambled hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), PART):
            np.minimum(least, (_FACTORS[:, None] * hashes[None, i : i + PART]).min(1), out=least)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for part in least.reshape(BANDS, ROWS).T:
            key = mix(key * np.uint64(31) + part)
    return key.view(np.int64)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, content, fp, id, size, keys): fingerprint, hash and size of the shingle set, its band keys."""

    @F.pandas_udf("fp bigint, id bigint, size int, keys array<bigint>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for t in batch]
            sets = [np.unique(h) for h in hashes]
            ids = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) for s in sets]
            yield pd.DataFrame({
                "fp": [majority(h) for h in hashes], "id": ids, "size": [len(s) for s in sets], "keys": [band_keys(s) for s in sets],
            })

    marked = docs.select("doc_id", "content", signature.asNondeterministic()(F.col("text")).alias("s"))
    return marked.select("doc_id", "content", "s.*")


def print_links(sets: DataFrame) -> DataFrame:
    """(a, b) between sets (``id``) whose fingerprints (``fp``) are within two bits; equal ones link to the least id."""
    spans = stored(sets.groupBy("fp").agg(F.min("id").alias("least"), F.max("id").alias("most")), "prints")
    equal = sets.join(spans.where("least < most"), "fp").select(F.col("id").alias("a"), F.col("least").alias("b"))
    named = lambda end: spans.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_id"))
    close = close_links(spans.select("fp")).join(named("a"), "a").join(named("b"), "b")
    return close.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(equal)


def representative_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every set (``id``, ``size``, ``keys``) and the representatives of its bands, where sizes allow the similarity.

    A band's representative is its least member in one of a few orders: few different ones, so that a family of
    copies has few pairs, but several, so that copies meet although another set comes before both in an order.
    """
    keys = sets.select("id", "size", F.explode("keys").alias("key"))
    rank = F.xxhash64("id", F.pmod("key", F.lit(ORDERS)))
    first = F.struct(rank.alias("rank"), "id", "size")
    heads = keys.groupBy("key").agg(F.min(first).alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head.id", "head.size")
    heads = heads.withColumnsRenamed({"id": "h_id", "size": "h_size"})
    alike = F.least("size", "h_size") / F.greatest("size", "h_size") >= similarity
    pairs = keys.join(heads, "key").where((F.col("id") != F.col("h_id")) & alike)
    return pairs.select(F.greatest("id", "h_id").alias("a"), F.least("id", "h_id").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets (``id``, ``hashes``) share this much of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("left", "right"))
    return both.where(common / (F.size("left") + F.size("right") - common) >= similarity).select("a", "b")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: the row with the least id of each group stays, all columns unchanged.

    Two documents link if their fingerprints are within two bits, or if one of them represents a band that both
    are in and they share at least ``similarity`` of the union of their distinct shingles.  Groups are the
    components of these links; equal sets always fall together.  Texts that are null or without words are one
    group.  A null id is less than any other.  Rows that repeat an id are told apart by their text, of which that
    with the least hash comes first; rows that repeat both count as one document, of which one stays.  An empty
    table stays empty.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("content"))
    rows = stored(shingle_sets(own, shingle), "shingles")
    place = F.struct("doc_id", "content")
    sets = rows.groupBy("id").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min(place).alias("least"))
    sets = stored(sets, "sets")
    pairs = stored(representative_pairs(sets, similarity), "pairs")

    @F.pandas_udf("array<bigint>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch])

    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    met = sets.join(met, "id", "left_semi").select("id", F.col("least.doc_id").alias("m_id"), F.col("least.content").alias("m_content"))
    texts = own.join(met, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("content") == F.col("m_content")))
    whole = stored(texts.select("id", hashes.asNondeterministic()(F.col("text")).alias("hashes")).dropDuplicates(["id"]), "hashes")
    links = print_links(rows.select("id", "fp").distinct()).unionByName(verified(pairs, whole, similarity))
    roots = components(links).withColumnRenamed("node", "id")
    classes = sets.select("id", "least").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "least")
    firsts = classes.groupBy("root").agg(F.min("least").alias("stay"))
    stays = stored(classes.join(firsts, "root").select("id", "stay"), "stays")
    # Only what goes, or is there twice, is looked for in the documents; their texts move no further than that asks.
    found = looked_up(rows.select("doc_id", "content", "id"), stays, "id").groupBy("doc_id", "content")
    told = found.agg(F.count("*").alias("n"), F.max(place == F.col("stay")).alias("stays"))
    told = stored(told.where("not stays or n > 1"), "told")
    key, other, flag, again = (fresh(docs, c) for c in ("content", "told_id", "told_stays", "told_content"))
    told = told.select(F.col("doc_id").alias(other), F.col("content").alias(again), F.col("stays").alias(flag))
    keyed = docs.withColumn(key, F.xxhash64(f"`{text}`"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(other)) & (F.col(key) == F.col(again))
    once = keyed.join(told.where(flag), same, "left_semi").dropDuplicates([doc_id, key])
    return keyed.join(told, same, "left_anti").unionByName(once).drop(key)
