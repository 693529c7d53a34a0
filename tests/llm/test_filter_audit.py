import random
from itertools import permutations
from math import factorial

import pytest

from lumenspan.llm import filter_audit


def test_lattice_counts_paths():
    for n in range(6):
        for state, (reach, leave) in filter_audit.lattice(n).items():
            assert (reach, leave) == (factorial(state.bit_count()), factorial(n - state.bit_count()))


def fails(text, copy):
    words = (text or "").encode().split()
    text = text or ""
    return [
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        any(c in "#$%&*|" for c in text), copy,
    ]


def walked(rows, good, toxic):
    """Every order, document by document."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = {}
    parts = {}
    for i, text, source in rows:
        parts.setdefault(source or "", []).append((i, fails(text, i is not None and first[text or ""] < i)))
    for part, docs in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                f = "ABCDE".index(name)
                gone = [d for d in left if d[1][f]]
                kept = [d for d in left if not d[1][f]]
                total[name] += len(gone)
                out[part, "".join(order), step] = [
                    name, len(kept), len(gone), sum(d[1][f] for d in docs) - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
                left = kept
        for key, row in out.items():
            if key[0] == part:
                row.append(total[row[0]])
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        words = [f"w{rng.randrange(rng.choice([20, 500]))}" for _ in range(rng.choice([10, 60, 60, 90]))]
        text = " ".join(words + rng.choice([[], [], ["#"], ["ABCDEFGHIJKLMNOPQRSTUVWXYZ"] * 3]))
        rows.append((i, text, rng.choice(["a", "a", "b", None, ""])))
    return rows + [(200 + k, rows[k % 9][1], "a") for k in range(40)]


FIGURES = ["name", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("extra", [[], "awkward"])
def test_audit_against_walking_every_order(spark, make_docs, awkward, extra):
    rows = corpus(2) + [(r[0], r[1], "odd") for r in (awkward if extra else [])]
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 230, 2)] + [(6, True, True), (6, False, False), (None, True, True), (8, None, None)]
    given = spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(make_docs(*rows).repartition(6), given)
    got = {(r.part, r.filter_order, r.step): [r[c] for c in FIGURES] for r in found.collect()}
    assert got == walked(rows, {i for i, q, _ in labels if q and i is not None}, {i for i, _, t in labels if t and i is not None})


def test_empty_table(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(make_docs((1, "x")).limit(0), labels).count() == 0


def test_edges_of_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5), ("p", 1, 2), ("p", 7, 4), ("p", 1, 1)], "part string, failed int, n long")
    found = filter_audit.edges(counts, "XYZ")
    assert found.count() == 12
    worth = {r.name: r.shapley for r in filter_audit.shapley(found).collect()}
    assert worth == {"X": 3 * 6 + 4 * 2, "Y": 4 * 2, "Z": 4 * 2}  # the 4 fail all three and fall to each first filter
    assert filter_audit.steps(found, "XYZ").count() == 18
    with pytest.raises(ValueError, match="not listed"):
        filter_audit.steps(found, "ABCDEFGH")
