"""Line-first cleaning: rules per line remove lines, then documents that lose too much text are rejected.

Per line, in this order: ``punctuation`` (no sentence ends in the line, or too many marks for its
words), ``navigation`` (link bars and menus) and ``boilerplate`` (short notices).  A document is rejected
if its base counts fail or if the removed lines hold more than ``max_loss`` of its word characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.base import fresh

# Fixed patterns; they are written so that Python, Java and RE2 read them alike.
CLOSING = r"""([.!?…。！？]["'”’»)\]]?[ \t\r\f\x0B]|[.!?:;"'”’»)\]…。！？][ \t\r\f\x0B]*$)"""
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"!!|\?\?|\*\*|##|%%|&&|\$\$"
BARS = r"[|»›•·]"
BOILERPLATE = (
    r"(all rights reserved|cookie|privacy policy|terms of (use|service)|javascript|click here|read more|"
    r"sign (in|up)|log ?in|subscribe|newsletter|share this|follow us|lorem ipsum|skip to (main )?content)"
)
#: A notice is a short line; a longer one may mention the same words.
NOTICE_WORDS = 12
WINDOW = 8

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, lost_chars long, lost_punctuation long, lost_navigation long, lost_boilerplate long, cleaned string"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document verdict."""

    max_loss: float = 0.3
    marks_per_word: float = 0.25
    symbols_per_word: float = 0.5
    min_bars: int = 2


_CLOSING, _SYMBOLS, _MARKS, _BARS = (re.compile(p) for p in (CLOSING, SYMBOLS, MARKS, BARS))
_BOILERPLATE = re.compile(BOILERPLATE)
_LOWER = {i: i + 32 for i in range(65, 91)}
_BLANKS = dict.fromkeys([0x20, *range(0x09, 0x0E)])


def line_fault(line: str, n_words: int, rules: Rules) -> str | None:
    """The first rule that the line breaks; lines without words break none."""
    if not n_words:
        return None
    if len(_BARS.findall(line)) >= rules.min_bars:
        return "navigation"
    if not _CLOSING.search(line):
        return "punctuation"
    if len(_MARKS.findall(line)) > rules.marks_per_word * n_words:
        return "punctuation"
    if len(_SYMBOLS.findall(line)) > rules.symbols_per_word * n_words:
        return "punctuation"
    if n_words <= NOTICE_WORDS and _BOILERPLATE.search(line.translate(_LOWER)):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of 8 words that occur twice or more; exact, by numbering runs of 1, 2, 4 and 8 words."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    size = 1
    while size < window:
        ids = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        size *= 2
        values, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
        if len(values) == len(ids):
            return 0
    repeated = np.flatnonzero(counts[ids] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None, rules: Rules) -> tuple:
    """The row of COLUMNS of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words, word_chars = len(words), len(text.translate(_BLANKS))
    seen: set[str] = set()
    copies, lost, kept_lines = 0, dict.fromkeys(("punctuation", "navigation", "boilerplate"), 0), []
    for line in text.split("\n"):
        count = len(line.encode("utf-8", "surrogatepass").split())
        copies += count > 0 and line in seen
        seen.add(line)
        fault = line_fault(line, count, rules)
        if fault:
            lost[fault] += len(line.translate(_BLANKS))
        else:
            kept_lines.append(line)
    repeats = repeated_words(words)
    base_failed = n_words < 20 or 100 * repeats > 30 * n_words
    total = sum(lost.values())
    return (
        n_words, word_chars, len(_SYMBOLS.findall(text)), copies, repeats, base_failed,
        not base_failed and total <= rules.max_loss * word_chars, total, *lost.values(), "\n".join(kept_lines),
    )


def assess(docs: DataFrame, rules: Rules = Rules(), text: str = "text", name: str = "quality") -> DataFrame:
    """All columns of the documents and a struct of COLUMNS under ``name``.

    A null text counts as an empty one: no words, base failed, not kept, cleaned text ''.  Lines without
    words are never removed.  Rows are independent: repeated rows get equal results, an empty table none.  The
    struct's name gets underscores before it while the documents have such a column.
    """
    names = [part.split()[0] for part in COLUMNS.split(", ")]

    @F.pandas_udf(COLUMNS)
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([measure(t, rules) for t in batch], columns=names)

    return docs.withColumn(fresh(docs, name), rate.asNondeterministic()(F.col(text)))


def clean(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The kept documents with their cleaned text; n_chars, where there is one, follows the text."""
    name = fresh(docs, "quality")
    kept = assess(docs, rules, text, name).where(F.col(name)["kept"])
    kept = kept.withColumn(text, F.col(name)["cleaned"])
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length(text).cast("bigint"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
