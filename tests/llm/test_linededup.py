import random

from lumenspan.llm import linededup


def slow(rows, min_words):
    """Positions to delete by comparing every run with every earlier one."""
    seen, gone = {}, {}
    for doc_id, text in rows:
        lines = [(p, x.strip(" \t\r\x0b\x0c")) for p, x in enumerate((text or "").split("\n")) if x.split()]
        gone[doc_id] = set()
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += len(lines[j][1].split())
                if words >= min_words:
                    run = tuple(x for _, x in lines[i : j + 1])
                    if seen.setdefault(run, (doc_id, i)) != (doc_id, i):
                        gone[doc_id] |= {p for p, _ in lines[i : j + 1]}
    return gone


def test_against_every_run(make_docs):
    rng = random.Random(2)
    stock = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 3, 6]))) for _ in range(9)]
    rows = [(d, "\n".join(rng.choice(stock + ["", "  "]) for _ in range(rng.randrange(14)))) for d in range(60)]
    got = {r.doc_id: set(r._removed) for r in linededup.dedup_lines(make_docs(*rows), min_words=6).collect()}
    want = slow(rows, 6)
    assert got == want and any(want.values())


def test_passage_in_many_documents(make_docs):
    passage = "\n".join(f"This is line {i} of a passage that many documents share among them." for i in range(5))
    rows = [(i, f"Own start {i}.\n{passage}\nOwn end {i}.") for i in range(40)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(make_docs(*rows)).collect()}
    assert got == {i: t if i == 0 else f"Own start {i}.\nOwn end {i}." for i, t in rows}


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(*awkward)
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_removed"]
    rows = got.collect()
    assert len(rows) == len(awkward)
    texts = {(r.doc_id, r.text) for r in rows}
    assert {(2, None), (None, None), (3, ""), (6, ""), (None, "no id here.")} <= texts
    assert sum(r.text == awkward[0][1] for r in rows) == 2
    assert linededup.dedup_lines(docs.limit(0)).collect() == []
