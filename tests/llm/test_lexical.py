import math
import random
import re

import pytest

from lumenspan.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_ranks(docs, items, k=10):
    bags = [(i, split(t)) for i, t in docs]
    bags = [(i, ts) for i, ts in bags if ts]
    n_docs, n_terms = len(bags), sum(len(ts) for _, ts in bags)
    holds = {}
    for _, ts in bags:
        for t in set(ts):
            holds[t] = holds.get(t, 0) + 1
    out = []
    for item, text in set(items):
        found = []
        for i, ts in bags:
            m = 100 - 75 + 75 * len(ts) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holds[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 8 * m))
                for t in split(text) if t in holds
            )
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "Über", "x1", "a-b", *(f"w{i}" for i in range(60))]
    docs = [(i, rng.choice([" ", ",", "\n"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(n)]
    docs += [(5, docs[5][1]), (6, "w1 w2 w3"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, "-- !!")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 20)))) for i in range(12)]
    items += [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (50, None), (51, ""), (52, "unknown"), (None, "w3 the")]
    return docs, items


@pytest.mark.parametrize("block_terms", [1 << 20, 25])
def test_ranks_against_all_scores(spark, make_docs, block_terms):
    docs, items = corpus(1)
    given = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.rank(make_docs(*docs).repartition(5), given, block_terms=block_terms)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_ranks(docs, items)


def test_ties_go_by_id_over_tasks_and_small_parts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 1)
    docs = [(i, "same words here") for i in range(200)] + [(500, "others only")]
    given = spark.createDataFrame([(1, "words")], "item_id long, text string")
    got = lexical.rank(make_docs(*docs).repartition(16), given, k=7).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(i + 1, i) for i in range(7)]


def test_ids_of_text_and_empty_tables(spark, make_docs):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "`d.id` string, body string")
    items = spark.createDataFrame([("q", "x")], "name string, query string")
    got = lexical.rank(docs, items, doc_id="d.id", text="body", item_id="name", item_text="query")
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    whole = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical.rank(make_docs((1, "x")).limit(0), whole).count() == 0
    assert lexical.rank(make_docs((1, "x")), whole.limit(0)).count() == 0


def test_awkward_documents(spark, make_docs, awkward):
    items = [(1, "plain text that w1x1"), (2, "é X here")]
    got = lexical.rank(make_docs(*awkward), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_ranks(awkward, items)
