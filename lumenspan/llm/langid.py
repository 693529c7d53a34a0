"""Language identification by cross-parsing.

A suffix automaton of labelled text is built for every language.  Parsing a text against it takes the longest
match from where the last one ended, again and again; the language that needs the fewest phrases for the
text's characters wins.  A phrase never needs suffix links: it follows transitions until there is none, then
starts again at the root, so the automaton becomes one table in which a missing transition leads to the
root's successor and counts a phrase.  Blocks of all documents of a batch walk through the tables in step.

Text is parsed in blocks of ``BLOCK`` characters: a phrase ends where its block does, and each block counts
for what it adds to the document's total.  Letters are lower-cased; everything else is one space.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.base import fresh, pieces

BLOCK = 512
UNKNOWN = "und"
#: Entries of all languages' full tables together, four bytes each; beyond that transitions are kept sorted.
DENSE = 1 << 26
#: Shares in which the documents of a language are ranked first.
SHARES = 256
_APART = re.compile(r"[\W\d_]+")


def letters_of(text: str | None) -> str:
    """The lower-cased letters of the text, one space for every run of other characters; '' without letters."""
    folded = _APART.sub(" ", (text or "").lower()).strip()
    return folded if any(map(str.isalpha, folded)) else ""


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions code -> state of every state of the smallest automaton of all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


class Sparse:
    """The answers of a full table from sorted transitions, for alphabets and languages too many for one."""

    def __init__(self, step: list[dict[int, int]], first: np.ndarray):
        self.width, self.first = len(first), first
        pairs = sorted((state * self.width + c, to) for state, out in enumerate(step) for c, to in out.items())
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([to for _, to in pairs] + [0], np.int64)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.keys, at)
        # At the root no phrase is open that could end.
        other = (self.first[at % self.width] << 1) + (at >= self.width)
        return np.where(self.keys[place] == at, self.to[place] << 1, other)


@dataclass(frozen=True)
class Model:
    """Learned languages, their sample texts and the letters told apart; automata are built once per process."""

    languages: tuple[str, ...]
    samples: tuple[str, ...]
    letters: str
    _built: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "samples": self.samples, "letters": self.letters, "_built": {}}

    @property
    def width(self) -> int:
        """Codes: the space, every letter, and one for letters that no sample has, which match nothing."""
        return len(self.letters) + 2

    def codes(self, text: str) -> np.ndarray:
        if "map" not in self._built:
            table = np.full(sys.maxunicode + 1, self.width - 1, np.int32)
            table[ord(" ")] = 0
            table[[ord(c) for c in self.letters]] = np.arange(1, len(self.letters) + 1)
            self._built["map"] = table
        return self._built["map"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def tables(self) -> list[np.ndarray | Sparse]:
        """Per language: (next state << 1) + 1 where a phrase ends before the character, by state and code."""
        key = ("tables", self.languages, hash(self.samples), self.letters)
        if key not in _PROCESS:
            _PROCESS.clear()
            # An automaton has fewer than two states a character.
            dense = sum(2 * len(sample) + 2 for sample in self.samples) * self.width <= DENSE
            _PROCESS[key] = [self._table(sample, dense) for sample in self.samples]
        return _PROCESS[key]

    def _table(self, sample: str, dense: bool) -> np.ndarray | Sparse:
        step = suffix_automaton([int(c) for c in self.codes(sample) if c != self.width - 1])
        # A character that the sample lacks is a phrase of its own: a state from which everything starts anew.
        alone = len(step)
        first = np.full(self.width, alone, np.int64)
        for c, to in step[0].items():
            first[c] = to
        if not dense:
            return Sparse(step, first)
        table = np.tile((first << 1) + 1, (alone + 1, 1)).astype(np.int32)
        for state, out in enumerate(step):
            for c, to in out.items():
                table[state, c] = to << 1
        table[0] = first << 1
        return table.ravel()

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(text, language) numbers of phrases, for texts of letters_of."""
        blocks, owners = [], []
        for i, text in enumerate(texts):
            codes = self.codes(text)
            for start in range(0, len(codes), BLOCK):
                blocks.append(codes[start : start + BLOCK])
                owners.append(i)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if not blocks:
            return counts
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        lanes = np.zeros((len(blocks), BLOCK), np.int32)
        for row, at in enumerate(order):
            lanes[row, : sizes[row]] = blocks[at]
        lanes = np.ascontiguousarray(lanes.T)
        alive = np.searchsorted(-sizes, -np.arange(BLOCK), side="left")
        for k, table in enumerate(self.tables()):
            at = np.zeros(len(blocks), np.int64)
            ended = np.zeros(len(blocks), np.int32)
            for j in range(int(sizes[0])):
                n = alive[j]
                to = table[at[:n] * self.width + lanes[j, :n]]
                ended[:n] += to & 1
                at[:n] = to >> 1
            # The phrase that is open at the end of a block is one more.
            np.add.at(counts[:, k], np.array(owners)[order], ended + 1)
        return counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; score is how far the runner-up is behind, 0 for a tie or no letters."""
        out: list[tuple[str, float]] = []
        clean = [letters_of(t) for t in texts]
        for start, end in pieces(clean):
            for text, row in zip(clean[start:end], self.phrases(clean[start:end])):
                if not text or not self.languages:
                    out.append((UNKNOWN, 0.0))
                    continue
                best = int(row.argmin())
                second = np.delete(row, best).min() if len(row) > 1 else len(text) + 1
                out.append((self.languages[best], float(1 - row[best] / second)))
        return out


_PROCESS: dict = {}


def train(
    docs: DataFrame, windows: int = 256, window: int = 256, max_languages: int | None = None, lang: str = "lang",
    doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Learn from the rows given (leave held-out ones out beforehand).

    Of every language, ``windows`` documents chosen by hash give ``window`` characters each, at a place that
    the hash chooses; all languages' windows are found in one pass.  Every language and every letter of its sample
    is learned; ``max_languages`` keeps the commonest languages only.  Rows without language or text are not used;
    rows that repeat an id have the same rank and go by their windows.  Without any row everything is ``und``.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - window + 1, F.lit(1))) + 1
    part = F.substring("text", start, F.lit(window))
    # Ranks that are too high are left out before each shuffle already; a language of very many tasks is ranked in
    # shares first, so that few rows of it meet.
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("rank", "part"))
    ranked = rows.select("lang", F.xxhash64("doc_id", F.lit(4)).alias("rank"), part.alias("part"))
    ranked = ranked.withColumn("share", F.pmod("rank", F.lit(SHARES))).withColumn("near", place("lang", "share"))
    ranked = ranked.where(F.col("near") <= windows).withColumn("place", place("lang")).where(F.col("place") <= windows)
    if max_languages is not None:
        commonest = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages)
        ranked = ranked.join(F.broadcast(commonest.select("lang")), "lang", "left_semi")
    parts: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["place"])):
        parts.setdefault(r["lang"], []).append(letters_of(r["part"]))
    languages = sorted(parts)
    samples = tuple(" ".join(p for p in parts[name] if p) for name in languages)
    letters = sorted(set().union(*samples) - {" "})
    return Model(tuple(languages), samples, "".join(letters))


def predict(docs: DataFrame, model: Model, name: str = "language", text: str = "text") -> DataFrame:
    """The documents with a struct of lang_pred and score; ``und`` and 0 for texts that are null or without letters.

    Of languages that need equally few phrases the first by name wins.  Equal texts get equal results, ids are not
    looked at, an empty table stays empty.  All columns are carried along; the new one gets underscores before its
    name while the documents have such a column.
    """

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(model.predict(list(batch)), columns=["lang_pred", "score"])

    return docs.withColumn(fresh(docs, name), identify.asNondeterministic()(F.col(f"`{text}`")))
