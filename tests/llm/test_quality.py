from collections import Counter

import pytest

from lumenspan.llm import quality
from lumenspan.llm.quality import Rules, line_fault, measure, repeated_words


def slow_repeats(words):
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(covered)


@pytest.mark.parametrize("pattern", ["abcdefgh" * 3, "abcdefghi" + "xyz" + "abcdefghi", "a" * 30, "abcdefg", "abcdefgh", ""])
def test_repeated_words(pattern):
    words = [c.encode() for c in pattern]
    assert repeated_words(words) == slow_repeats(words)


@pytest.mark.parametrize(
    ("line", "fault"),
    [
        ("A sentence that ends.", None), ("It ends here. then trails off", None), ("", None), ("no end at all", "punctuation"),
        ("BUY!! NOW!! HERE!!", "punctuation"), ("home | news | about", "navigation"), ("All rights reserved.", "boilerplate"),
        ("They signed the privacy policy after long talks about who may read the letters of whom and when.", None),
    ],
)
def test_line_rules(line, fault):
    assert line_fault(line, len(line.split()), Rules()) == fault


def test_documents(make_docs, awkward):
    good = "\n".join(f"Sentence number {i} of a text about {i * 7} other things." for i in range(8))
    docs = make_docs((10, good + "\nhome | news | about"), (11, good[:60] + "\n" + "a | b | c | d\n" * 9), *awkward)
    rated = {(r.doc_id, r.text): r._quality for r in quality.assess(docs).collect()}
    assert rated[10, good + "\nhome | news | about"].kept and rated[10, good + "\nhome | news | about"].cleaned == good
    assert not rated[11, good[:60] + "\n" + "a | b | c | d\n" * 9].kept
    for text in (None, "", " \n\t\n "):
        row = next(q for (_, t), q in rated.items() if t == text)
        assert (row.n_words, row.word_chars, row.base_failed, row.kept) == (0, 0, True, False)
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in kept.collect()] == [(10, good, len(good))]
    assert quality.clean(docs.limit(0)).collect() == []


def test_counts():
    row = measure("A b\nA b\n\n\nc # % é", Rules())
    assert row[:5] == (8, 8, 2, 1, 0)
