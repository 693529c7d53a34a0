"""Removal of repeated runs of lines by winnowing over line hashes.

A run is a stretch of consecutive lines (blank lines are skipped) with at least ``min_words`` words.  Every
shortest run that starts at a line is a window; the least line hash of the window is selected, so two places
that share a run share a fingerprint.  Fingerprints selected at two or more positions are joined back to the
lines.  A match is extended forwards (the shortest run that starts at a line) and backwards (the shortest run
that ends there); runs around a matched fingerprint are compared with their first occurrence in (doc_id,
position) order, and all lines of later ones are deleted.  This deletes exactly the lines that lie in any run
of the given size that has occurred before, however many documents share it: occurrences meet only their
first one, counts and firsts are combined before the shuffle, and no pairs are built.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.base import WORD, fresh, looked_up, stored

BLANKS = "[\\x20\\x09-\\x0D]+"


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per line with a word: document key, position, hash of the trimmed line, words and words so far."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("content"), F.split(f"`{text}`", "\n").alias("lines"))
    each = own.select("doc_id", "content", F.posexplode("lines").alias("pos", "line"))
    each = each.withColumn("w", F.regexp_count("line", F.lit(WORD)).cast("bigint")).where("w > 0")
    trimmed = F.regexp_replace("line", f"^{BLANKS}|{BLANKS}$", "")
    each = each.select("doc_id", "content", "pos", "w", F.xxhash64(trimmed).alias("h"))
    # Rows repeated as a whole are one document here.
    once = each.repartition("doc_id", "content").dropDuplicates(["doc_id", "content", "pos"])
    before = Window.partitionBy("doc_id", "content").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("done", F.coalesce(F.sum("w").over(before), F.lit(0)))


def _windows(min_words: int) -> tuple[Window, Window]:
    """Frames of the shortest run that starts, and that ends, at a line."""
    own = Window.partitionBy("doc_id", "content")
    start = own.orderBy("done").rangeBetween(0, min_words - 1)
    end = own.orderBy(F.col("done") + F.col("w")).rangeBetween(-(min_words - 1), 0)
    return start, end


def repeated_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, content, pos): what runs to delete cover, blank lines between their lines included.

    content is the hash of the text, positions count from 0.
    """
    start, end = _windows(min_words)
    lines = stored(_lines(docs, doc_id, text), "lines")
    selected = lines.select(
        "doc_id", "content",
        F.sum("w").over(start).alias("total"),
        F.min(F.struct("h", -F.col("pos"))).over(start).alias("pick"),
    ).where(F.col("total") >= min_words)
    prints = selected.select("doc_id", "content", F.col("pick.h").alias("h"), F.col("pick.col2").alias("at")).distinct()
    shared = prints.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(1).alias("hit"))
    marked = looked_up(lines, shared, "h")
    run = lambda frame: F.xxhash64(F.collect_list("h").over(frame), F.collect_list("w").over(frame))
    found = lambda frame: (F.sum("w").over(frame) >= min_words) & F.max("hit").over(frame).isNotNull()
    place = lambda first, last: F.struct(first.alias("first"), last.alias("last"))
    around = marked.select(
        "doc_id", "content", "pos",
        F.when(found(start), F.struct(run(start).alias("key"), place(F.col("pos"), F.max("pos").over(start)).alias("at"))).alias("forward"),
        F.when(found(end), F.struct(run(end).alias("key"), place(F.min("pos").over(end), F.col("pos")).alias("at"))).alias("backward"),
    )
    runs = around.select("doc_id", "content", F.explode(F.array("forward", "backward")).alias("run")).where("run is not null")
    runs = stored(runs.select("run.key", F.struct("doc_id", "content", F.col("run.at.first").alias("first")).alias("place"), F.col("run.at.last").alias("last")), "runs")
    firsts = runs.groupBy("key").agg(F.min("place").alias("earliest"), F.max("place").alias("latest"))
    firsts = firsts.where("earliest < latest").drop("latest")
    later = looked_up(runs, firsts, "key", "inner").where("earliest < place")
    spans = later.select("place.doc_id", "place.content", F.explode(F.sequence("place.first", "last")).alias("pos"))
    return spans.distinct()


def _worded(lines: Column, places: Column) -> Column:
    """The places without those of blank lines."""
    blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(WORD), i)), lambda i: i.isNotNull())
    return F.array_except(places, blank)


def _kept(lines: Column, removed: Column) -> Column:
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text", removed: str = "removed") -> DataFrame:
    """The documents with later repeated runs deleted from the text, and the sorted positions of removed lines.

    The first occurrence stays.  Blank lines always stay.  A null text stays null and has
    no lines; an empty one stays empty.  A null id sorts first.  Rows that repeat an id are told apart by
    their text; rows repeated as a whole count as one document and get the same result.  Other columns are
    carried along unchanged, an empty table stays empty.  The added column gets underscores before its name
    while the documents have such a column.
    """
    removed = fresh(docs, removed)
    gone = repeated_lines(docs, min_words, doc_id, text)
    gone = gone.groupBy("doc_id", "content").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    own, places, lines, other, content = (fresh(docs, c) for c in ("own", "places", "lines", "gone_id", "gone_content"))
    gone = gone.select(F.col("doc_id").alias(other), F.col("content").alias(content), F.col("gone").alias(places))
    # The lines travel in place of the text, so that no expression splits it again for each of its lines.
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    keyed = docs.select(*others, F.split(f"`{text}`", "\n").alias(lines), F.xxhash64(f"`{text}`").alias(own))
    both = keyed.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(other)) & (F.col(own) == F.col(content)), "left")
    both = both.withColumn(places, F.when(F.col(places).isNotNull(), _worded(F.col(lines), F.col(places))))
    whole = F.array_join(lines, "\n")
    kept = F.when(F.col(places).isNull(), whole).otherwise(_kept(F.col(lines), F.col(places)))
    none = F.array().cast("array<int>")
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*columns, F.coalesce(F.col(places), none).alias(removed))
