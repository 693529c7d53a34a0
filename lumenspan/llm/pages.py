"""Main text of web pages: markup first, then what pages with neighbouring addresses have in common.

The text lines of a page (``html_lines``) fall into three kinds: lines in elements that are never main text, lines
inside an article that the page declares, and the rest.  For the rest, and for link text inside articles, pages
decide about each other: within a host, pages are ordered by path, each is aligned with the page before and the
page after it by the longest common subsequence of their lines, and lines that either shares are deleted.  Two
pages that share more than half of their characters are copies, which say nothing about what frames a text.

Only line hashes travel: they are ordered by ranges of (host, path, query), so a host with any share of the pages
is many ranges, and the first and last page of each range travel to the ranges beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.base import fresh, stored
from lumenspan.llm.html_lines import Line, common_lines, page_lines

#: Pages that share more than this part of their characters are copies.
COPY = 0.5
ORDER = ["host", "path", "query", "key"]
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def _hashed(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))


def kept_lines(html: str | None) -> tuple[list[Line], list[tuple[int, Line, bool]]]:
    """All lines of a page; and position, line and firmness of those that markup leaves as text.

    Lines of a declared article are firm unless they are mostly links: neighbours do not decide about them.
    """
    read = page_lines(html)
    declared = any(x.article and not x.rejected for x in read)
    return read, [(i, x, declared and not x.linked) for i, x in enumerate(read) if not x.rejected and x.article >= declared]


def _hashes(pages: DataFrame) -> DataFrame:
    """(host, path, query, key, lines, sizes, loose) of each distinct page (url, html) that has a host.

    ``loose`` are the positions of lines that neighbours decide about.
    """

    @F.pandas_udf("lines array<bigint>, sizes array<int>, loose array<int>")
    def lines(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for html in batch:
                read, kept = kept_lines(html)
                out.append(([_hashed(x.text) for x in read], [len(x.text) for x in read], [i for i, _, firm in kept if not firm]))
            yield pd.DataFrame(dict(zip(("lines", "sizes", "loose"), zip(*out, strict=True), strict=True)) if out else {"lines": [], "sizes": [], "loose": []})

    host = F.lower(F.regexp_extract("url", _HOST, 1))
    path, query = F.regexp_extract("url", _PATH, 1), F.regexp_extract("url", r"\?([^#]*)", 1)
    own = pages.select(host.alias("host"), path.alias("path"), query.alias("query"), F.xxhash64("url", "html").alias("key"), "html")
    read = own.where("host <> ''").withColumn("read", lines.asNondeterministic()(F.col("html")))
    return read.select(*ORDER, "read.*")


def neighbours(rows: DataFrame) -> DataFrame:
    """The rows with ``before`` and ``after``: lines and sizes of the nearest pages of the same host.

    Ranges of the whole order are windows of their own; what lies across a border is one row per range.
    """
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("range", F.spark_partition_id())
    ordered = stored(ordered, "by-address")
    page = F.struct("host", "lines", "sizes")
    inside = Window.partitionBy("range").orderBy(*ORDER)
    place = F.struct(*ORDER)
    ends = ordered.groupBy("range").agg(F.min_by(page, place).alias("first"), F.max_by(page, place).alias("last"))
    # One row per range: as many as there were tasks.
    across = Window.orderBy("range")
    beside = ends.select("range", F.lag("last").over(across).alias("left"), F.lead("first").over(across).alias("right"))
    placed = ordered.withColumn("before", F.lag(page).over(inside)).withColumn("after", F.lead(page).over(inside)).join(beside, "range", "left")
    of_host = lambda near, border: F.when(F.coalesce(F.col(f"{near}.host"), F.col(f"{border}.host")) == F.col("host"), F.coalesce(near, border))
    return placed.select("key", "lines", "sizes", "loose", of_host("before", "left").alias("before"), of_host("after", "right").alias("after"))


def shared_places(lines: list[int], sizes: list[int], others: list[tuple[list[int], list[int]]]) -> set[int]:
    """Positions of lines shared with any of the other pages that is no copy."""
    found: set[int] = set()
    for their_lines, their_sizes in others:
        common = common_lines(lines, their_lines)
        if sum(sizes[i] for i in common) <= COPY * max(1, min(sum(sizes), sum(their_sizes))):
            found.update(common)
    return found


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, gone): positions of the lines to delete, of each distinct page that has any."""

    @F.pandas_udf("array<int>")
    def gone(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out = []
            for lines, sizes, loose, *near in zip(*columns, strict=True):
                others = [(list(a), list(b)) for a, b in (near[:2], near[2:]) if a is not None]
                out.append(sorted(shared_places(list(lines), list(sizes), others) & set(loose)) if len(loose) else [])
            yield pd.Series(out)

    near = neighbours(_hashes(pages).dropDuplicates(["key"]))
    told = near.select("key", gone.asNondeterministic()("lines", "sizes", "loose", "before.lines", "before.sizes", "after.lines", "after.sizes").alias("gone"))
    return told.where(F.size("gone") > 0)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", name: str = "main") -> DataFrame:
    """The pages with a column (text, n_lines, n_shared): main text, lines of the page, and lines deleted because a
    neighbouring page has them too.

    Lines that markup rejects are never text.  On a page that declares an article, its lines are the text, but for
    shared ones that are mostly links; on other pages, all lines that are not shared.  Lines are joined by one
    space.  A null or empty page has an empty text.  A page whose address is null or has no host is compared with
    none.  Pages are told apart by address and content; pages repeated as a whole are one, and all get the same
    result.  An empty table stays empty.  All columns are carried along; the new one gets underscores before its
    name while the pages have such a column.
    """
    name, own, other, told = (fresh(pages, c) for c in (name, "page_key", "other_key", "verdict"))

    @F.pandas_udf("lines array<struct<text: string, at: int>>, n int")
    def lines(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, counts = [], []
            for html in batch:
                read, kept = kept_lines(html)
                out.append([{"text": x.text, "at": i} for i, x, _ in kept])
                counts.append(len(read))
            yield pd.DataFrame({"lines": out, "n": counts})

    source = pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    # Only pages that lose a line are looked for: few where pages declare their articles.
    verdicts = stored(shared_lines(source), "shared-lines").select(F.col("key").alias(other), F.col("gone").alias(told))
    carried = [F.col(f"`{c}`") for c in pages.columns]
    page = F.xxhash64(f"`{url}`", f"`{html}`")
    both = pages.select(*carried, page.alias(own), lines.asNondeterministic()(F.col(f"`{html}`")).alias(name))
    both = both.join(verdicts, F.col(own) == F.col(other), "left")
    gone = lambda x: F.coalesce(F.array_contains(F.col(told), x["at"]), F.lit(False))
    left = F.filter(F.col(name)["lines"], lambda x: ~gone(x))
    text = F.array_join(F.transform(left, lambda x: x["text"]), " ")
    figures = F.struct(
        text.alias("text"),
        F.col(name)["n"].cast("bigint").alias("n_lines"),
        (F.size(F.col(name)["lines"]) - F.size(left)).cast("bigint").alias("n_shared"),
    )
    return both.select(*carried, figures.alias(name))
