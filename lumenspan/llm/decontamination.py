"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a run of words: the words at its ones are hashed, those at its zeros are ignored,
so a passage with single words replaced still shares seeds with its original.  Seeds of the test items are
joined with seeds of the documents; every hit gives a diagonal (document position minus item position), and
the words along it are compared: a leak is a window of ``window`` item words of which at least ``share`` are
equal.  Items shorter than the window are compared over their whole length; items of fewer than three words are
never looked for.  The masks depend on how many words are compared and how many of them may differ: wherever
those are, one of the masks meets equal words only, so no passage that the comparison accepts is missed.

Where every mask begins with two ones, a document position matters only if its pair of words occurs in some
item.  A constant of fixed size with a flag per hashed pair tells that before seeds are hashed or exploded;
it only spares work, also when it fills up.  The seeds are broadcast while they are counted to be few, and joined by a
shuffle beyond that.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import alnum_words, fresh, stored

#: Fixed masks; each begins with two ones.  Those for 20 words span 12 and more, so that passages that share no more
#: than a common opening of ten words have no seed in common.
WIDE = ("110100010011", "1100100001101", "110010000000111")
MIDDLE = ("110100011", "11100101")
#: Masks, and by the number of words that may differ the fewest compared words for which they miss nothing.
FAMILIES = (
    (WIDE, {4: 20}),
    (MIDDLE, {2: 12, 3: 15}),
    (("11101", "1111"), {2: 10}),
    (("1111", "11011"), {1: 6}),
    (("111", "1101"), {1: 5}),
)
MIN_ITEM = 3
#: Seeds that may be broadcast: at 24 bytes each under 50 MB.
BROADCAST_SEEDS = 2_000_000
FLAGS = 1 << 18


def _hashes(text: str) -> Column:
    return F.transform(alnum_words(F.lower(text)), lambda w: F.xxhash64(w))


def masks_for(need: int, share: float) -> tuple[str, ...]:
    """Masks of which one meets equal words only in every passage of ``need`` words that the share accepts."""
    differ = need - math.ceil(share * need)
    for masks, least in FAMILIES:
        if need >= least.get(differ, need + 1):
            return masks
    # So many words in a row are equal wherever the others are.
    return ("1" * max(1, math.ceil((need - differ) / (differ + 1))),)


def _seed(words: Column, i: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, i + k) for k, bit in enumerate(mask) if bit == "1"])


def _seeds(words: Column, i: Column, masks: dict[str, Column]) -> Column:
    """The seeds that fit behind position i, of the masks whose condition holds."""
    size = F.size(words)
    return F.array_compact(F.array(*[F.when(test & (i + len(m) <= size), _seed(words, i, m)) for m, test in masks.items()]))


def _flags(items: DataFrame) -> Column:
    """A constant of FLAGS bytes, one for the slot of every adjacent pair of item words."""
    pairs = items.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: _slot(F.col("words"), i))).alias("slot"))
    flags = bytearray(FLAGS)
    for row in pairs.groupBy(F.col("slot").alias("slot")).count().collect():  # at most FLAGS
        flags[row["slot"]] = 1
    return F.lit(bytes(flags))


def _slot(words: Column, i: Column) -> Column:
    return F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(FLAGS)).cast("int")


def leaks(
    docs: DataFrame, items: DataFrame, window: int = 20, share: float = 0.8, masks: tuple[str, ...] | None = None,
    doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """One row per document and item of which it holds a passage: the best diagonal's overlap.

    Columns: doc_id, content (hash of the text), item_id, first_word (where the item begins or would begin in
    the document, counted from 0), n_compared and n_equal words along the diagonal, best_window (most equal
    words in a window).  Null and empty texts hold nothing.  Items that repeat an id are told apart by text
    and reported once, by their best overlap; documents repeated as a whole are one.  A null id is a value
    like any other.  Other columns of either table are not read; empty tables give no rows.  Masks that are
    given replace those that miss nothing.
    """
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), _hashes(f"`{text}`").alias("words")).where(F.size("words") >= MIN_ITEM)
    items = stored(items.distinct().select("item_id", F.xxhash64("words").alias("item"), "words"), "items")
    need = F.least(F.size("words"), F.lit(window))
    users: dict[str, list[int]] = {}
    for row in items.select(need.alias("need")).distinct().orderBy("need").collect():  # at most window
        for m in masks or masks_for(row["need"], share):
            users.setdefault(m, []).append(row["need"])
    shortest = min(map(len, users), default=MIN_ITEM)
    position = F.explode(F.sequence(F.lit(0), F.size("words") - shortest)).alias("q")
    own = {m: need.isin(needs) for m, needs in users.items()}
    seeds = items.where(F.size("words") >= shortest).select("item", "words", position).select(
        "item", "q", F.explode(_seeds(F.col("words"), F.col("q"), own)).alias("seed")
    )
    seeds = stored(seeds, "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    words = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    words = words.select("doc_id", F.xxhash64("text").alias("content"), _hashes("text").alias("words"))
    words = words.where(F.size("words") >= MIN_ITEM)
    flags = _flags(items)
    known = lambda i: F.substring(flags, _slot(F.col("words"), i) + 1, F.lit(1)) == F.lit(b"\x01")
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - shortest, F.lit(0)))
    if all(m.startswith("11") for m in users):
        places = F.filter(places, known)
    gated = words.select("doc_id", "content", "words", F.explode(places).alias("p"))
    probes = gated.select("doc_id", "content", "p", F.explode(_seeds(F.col("words"), F.col("p"), dict.fromkeys(users, F.lit(True)))).alias("seed"))
    hits = probes.join(seeds, "seed").select("doc_id", "content", "item", (F.col("p") - F.col("q")).alias("diagonal"))
    hits = stored(hits.distinct(), "hits")
    hit_docs = hits.select(F.col("doc_id").alias("h_id"), F.col("content").alias("h_content")).distinct()
    own = words.join(hit_docs, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("content") == F.col("h_content")), "left_semi")
    own = own.dropDuplicates(["doc_id", "content"]).select(
        F.col("doc_id").alias("d_id"), F.col("content").alias("d_content"), F.col("words").alias("d_words")
    )
    both = hits.join(own, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("content") == F.col("d_content")))
    both = both.join(items.withColumnRenamed("words", "i_words"), "item")
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    high = F.least(F.size("i_words"), F.size("d_words") - F.col("diagonal")) - 1
    equal = F.transform(
        F.sequence(low, high), lambda q: (F.get("i_words", q) == F.get("d_words", q + F.col("diagonal"))).cast("int")
    )
    both = both.select("doc_id", "content", "item_id", F.col("diagonal").alias("first_word"), equal.alias("equal"), F.least(F.size("i_words"), F.lit(window)).alias("need"))
    sums = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    last = F.size("equal") - F.col("need")
    best = F.array_max(F.transform(F.sequence(F.lit(1), last + 1), lambda i: sums(F.slice("equal", i, F.col("need")))))
    found = both.where(last >= 0).select(
        "doc_id", "content", "item_id", F.col("first_word").cast("bigint").alias("first_word"),
        F.size("equal").cast("bigint").alias("n_compared"), sums(F.col("equal")).cast("bigint").alias("n_equal"),
        best.cast("bigint").alias("best_window"), "need",
    ).where(F.col("best_window") >= F.ceil(F.lit(share) * F.col("need")))
    order = F.struct("best_window", "n_equal", -F.col("first_word"), "n_compared")
    top = found.groupBy("doc_id", "content", "item_id").agg(F.max(order).alias("best"))
    return top.select(
        "doc_id", "content", "item_id", (-F.col("best.col3")).alias("first_word"), "best.n_compared", "best.n_equal", "best.best_window"
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that hold no passage of any item (see ``leaks``); all columns unchanged.

    Null and empty texts hold nothing and stay, as do all documents where there is no item.  Of rows that repeat an
    id only those whose text holds a passage go; rows repeated as a whole stay or go together.  A null id is a value
    like any other.  An empty table stays empty.
    """
    found = leaks(docs, items, doc_id=doc_id, text=text, **how)
    own, other, content = (fresh(docs, c) for c in ("own", "leak_id", "leak_content"))
    found = found.select(F.col("doc_id").alias(other), F.col("content").alias(content)).distinct()
    keyed = docs.withColumn(own, F.xxhash64(f"`{text}`"))
    clean = keyed.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(other)) & (F.col(own) == F.col(content)), "left_anti")
    return clean.drop(own)
