"""Licence scans by ordered signature rules.

A rule is tried on a document only if the document holds the rule's keyword, with any white space between its
words as patterns have it.  Every match is an interval of
the text.  An interval falls if another one contains it and has a higher priority, or the same priority and
more text; equal intervals of equal priority both stay.  What is left gives the labels and the score, the
highest confidence.  Apart from the rules, three plain phrases are looked for as consecutive words.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.base import NOT_ALNUM, alnum_words, fold
from lumenspan.llm.license_rules import rules, rules_json

#: Phrases that are found as consecutive words, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
PHRASE_SCORE = 0.9
ALNUM = NOT_ALNUM.replace("[", "[^", 1)
_RULE = "array<struct<rule string, label string, priority int, confidence double, gate string, keyword string, pattern string>>"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _all_words(text: Column, phrase: str) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in phrase.split()])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def detections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, rule, label, confidence, first, last) of every match that is not suppressed.

    content is the hash of the text; first and last are character positions, from 0, last excluded.  Rows
    that repeat a document as a whole are scanned once.  Null and empty texts have no matches.
    """
    every = F.from_json(F.lit(rules_json()), _RULE)
    gates = sorted({r.gate for r in rules()})
    low = _keyed(docs, doc_id, text).withColumn("low", F.lower("text"))
    gated = low.where(_any([_all_words(F.col("low"), g) for g in gates])).select("doc_id", "content", fold(F.col("text")).alias("text"))
    # As the element of an array the squeezed text is made once, not for every rule.
    squeezed = F.array(F.regexp_replace("text", r"\s+", " "))
    tried = F.flatten(F.transform(squeezed, lambda t: F.filter(every, lambda r: F.contains(t, r["keyword"]))))
    work = gated.select("doc_id", "content", "text", F.explode(tried).alias("r"))
    # The text around the k-th match is the k-th piece of the split, so lengths alone give the places.
    found = work.select(
        "doc_id", "content", "r",
        F.regexp_extract_all("text", F.col("r.pattern"), F.lit(0)).alias("matches"),
        F.split("text", F.col("r.pattern"), -1).alias("between"),
    ).where(F.size("matches") > 0)
    lengths = F.transform("matches", lambda m, k: F.struct(F.length(F.get("between", k)).alias("gap"), F.length(m).alias("size")))
    rule = [F.col(f"r.{c}").alias(c) for c in ("rule", "label", "priority", "confidence")]
    each = found.select("doc_id", "content", *rule, F.posexplode(lengths).alias("k", "n"))
    # One exchange by document serves all that follows.
    each = each.repartition("doc_id", "content").dropDuplicates(["doc_id", "content", "rule", "k"])
    so_far = Window.partitionBy("doc_id", "content", "rule").orderBy("k")
    placed = each.withColumn("last", F.sum(F.col("n.gap") + F.col("n.size")).over(so_far))
    placed = placed.select("doc_id", "content", "rule", "label", "priority", "confidence", (F.col("last") - F.col("n.size")).alias("first"), "last")
    # Outer intervals come first; equal ones share a number.
    own = Window.partitionBy("doc_id", "content")
    ranked = placed.withColumn("o", F.dense_rank().over(own.orderBy(F.col("first"), F.col("last").desc())).cast("bigint"))
    upto, before = (own.orderBy("o").rangeBetween(Window.unboundedPreceding, end) for end in (0, -1))
    levels = sorted({r.priority for r in rules()})
    reach = lambda p, frame: F.coalesce(F.max(F.when(F.col("priority") == p, F.col("last"))).over(frame), F.lit(-1))
    ranked = ranked.select("*", *[reach(p, upto).alias(f"upto{p}") for p in levels], *[reach(p, before).alias(f"before{p}") for p in levels])
    covered = _any(
        [
            (F.col("priority") < p) & (F.col(f"upto{p}") >= F.col("last"))
            | (F.col("priority") == p) & (F.col(f"before{p}") >= F.col("last"))
            for p in levels
        ]
    )
    return ranked.where(~covered).select("doc_id", "content", "rule", "label", "confidence", "first", "last")


def _phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    fits = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))), lambda i: F.coalesce(fits(i), F.lit(False)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text counts as an empty one: no words, no labels ('' and score 0).  Words are runs of ASCII letters,
    digits and characters beyond ASCII.  Repeated rows stay repeated; other columns are not read.
    """
    own = _keyed(docs, doc_id, text)
    low = F.lower("text")
    words = F.when(_any([_all_words(low, p) for p in PHRASES]), alnum_words(fold(F.col("text"))))
    places = [_phrase_places(F.col("words"), p) for p in PHRASES]
    base = own.select("doc_id", "content", F.regexp_count("text", F.lit(ALNUM)).cast("bigint").alias("n_words"), words.alias("words"))
    base = base.select("doc_id", "content", "n_words", F.when(F.col("words").isNotNull(), F.array(*places)).alias("places"))
    hits = F.flatten("places")
    names = F.array(*[F.when(F.size(F.col("places")[i]) > 0, name) for i, name in enumerate(PHRASES.values())])
    base = base.select(
        "doc_id", "content", "n_words",
        F.coalesce(F.when(F.col("places").isNotNull(), F.size(hits)), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min(hits).cast("bigint").alias("first_word"), F.array_max(hits).cast("bigint").alias("last_word"),
        F.when(F.col("places").isNotNull(), F.array_compact(names)).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    found = detections(docs, doc_id, text).groupBy("doc_id", "content")
    found = found.agg(F.collect_set("label").alias("more"), F.max("confidence").alias("best"))
    found = found.select(F.col("doc_id").alias("_found_id"), F.col("content").alias("_found_content"), "more", "best")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("_found_id")) & (F.col("content") == F.col("_found_content")), "left")
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    none = F.array().cast("array<string>")
    phrase = F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(0.0)
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text_of(F.col("base")).alias("base_labels"),
        text_of(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.greatest(phrase, F.coalesce("best", F.lit(0.0))).alias("score"),
    )
