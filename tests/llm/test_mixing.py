import hashlib
import math
from collections import Counter

from lumenspan.llm import mixing


def slow_count(seed, doc_id, rate):
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:1".encode()).hexdigest()[:13], 16) / 16**13
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_follow_the_inverse_distribution(make_docs):
    rows = [(i, f"text {i}", "big" if i % 10 else "small") for i in range(600)]
    docs = make_docs(*rows)
    got = mixing.mix(docs, {"big": 1, "small": 1, "none": 3})
    assert got.columns == [*docs.columns, "_replica", "_shuffle_key"]
    found = got.collect()
    rate = {"big": 600 * 0.2 / 540, "small": 600 * 0.2 / 60}
    # Shares are among the sources there are.
    rate = {s: r / 0.4 for s, r in rate.items()}
    copies = Counter(r.doc_id for r in found)
    assert {i: copies[i] for i, _, _ in rows} == {i: slow_count(17, i, rate[s]) for i, _, s in rows}
    assert {(r.doc_id, r._replica) for r in found} == {(i, k) for i, n in copies.items() for k in range(n)}
    keys = [r._shuffle_key for r in found]
    assert keys == sorted(keys) and [r.doc_id for r in found] != sorted(r.doc_id for r in found)


def test_large_rates_and_missing_sources(make_docs):
    docs = make_docs((1, "one", "rare"), *[(i, "x", None) for i in range(2, 2000)], clashing=False)
    found = Counter(r.source for r in mixing.mix(docs, {"rare": 1.0}).select("source").collect())
    assert set(found) == {"rare"} and 1800 < found["rare"] < 2200
    assert mixing.mix(docs, {}).collect() == []


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(*[(*r, None if i % 2 else "s") for i, r in enumerate(awkward)])
    found = mixing.mix(docs, size=50.0).collect()
    assert {(r.doc_id, r.text) for r in found} == set(awkward)
    twice = Counter((r.doc_id, r.text, r.source) for r in found)
    assert all(n > 0 for n in twice.values())
    assert mixing.mix(docs.limit(0)).collect() == []
