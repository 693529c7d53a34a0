import itertools
import math
import random

import pytest

from lumenspan.llm import decontamination

ITEM = "alpha beta gamma delta one two three four five six seven eight nine ten red green blue black white grey pink gold iron tin lead".split()


def changed(words, every):
    return [f"z{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


@pytest.fixture
def items(spark):
    rows = [(0, " ".join(ITEM), "x"), (1, "Short item, of six words.", "x"), (2, "two words", "x"), (3, None, "x"), (None, "no id but a passage of some words in it", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, words string")


def test_passages(make_docs, items):
    rng = random.Random(3)
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    texts = {
        1: noise(30) + ITEM + noise(9), 2: noise(5) + changed(ITEM, 6), 3: changed(ITEM, 3), 4: noise(90), 5: ITEM[:12] + noise(20),
        6: noise(3) + ["SHORT", "item", "of-six", "words!"], 7: ITEM[3:24], 8: ["two", "words"],
    }
    found = decontamination.leaks(make_docs(*[(i, " ".join(t)) for i, t in texts.items()]), items).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert set(got) == {(1, 0), (2, 0), (6, 1), (7, 0)}
    assert (got[1, 0].first_word, got[1, 0].n_equal, got[1, 0].best_window) == (30, 25, 20)
    assert got[7, 0].first_word == -3 and got[7, 0].n_compared == 21


def test_clean_documents_stay(make_docs, items, awkward):
    docs = make_docs(*awkward, (100, "x " + " ".join(ITEM)), (101, "so: no id but a passage of some words in it"))
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, awkward))
    assert decontamination.decontaminate(docs.limit(0), items).collect() == []
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


def test_masks_begin_alike():
    assert all(m.startswith("11") and m.endswith("1") for masks, _ in decontamination.FAMILIES for m in masks)
    assert all(len(m) > 10 for m in decontamination.masks_for(20, 0.8))


def test_a_common_opening_makes_no_pairs(spark, make_docs, monkeypatch):
    """Items and documents that all begin with the same ten words and go on differently."""
    stored, rows = decontamination.stored, {}

    def counted(df, label):
        out = stored(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(decontamination, "stored", counted)
    rng = random.Random(6)
    opening = [f"o{i}" for i in range(10)]
    text = lambda n: " ".join(opening + [f"x{rng.randrange(10**7)}" for _ in range(n)])
    hits = []
    for n in (50, 100, 200):
        given = spark.createDataFrame([(i, text(25)) for i in range(n)], "item_id long, text string")
        assert decontamination.leaks(make_docs(*[(i, text(60)) for i in range(n)]), given).count() == 0
        hits.append(rows["hits"])
    assert hits[2] <= 200


def test_without_broadcast(make_docs, items, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", -1)
    found = decontamination.leaks(make_docs((1, "a b " + " ".join(ITEM)), (2, "c d e f g")), items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 0)]


@pytest.mark.parametrize("need", range(3, 21))
def test_masks_meet_every_passage(need):
    masks = decontamination.masks_for(need, 0.8)
    for wrong in itertools.combinations(range(need), need - math.ceil(0.8 * need)):
        assert any(
            all(bit == "0" or at + i not in wrong for i, bit in enumerate(m)) for m in masks for at in range(need - len(m) + 1)
        )


@pytest.mark.parametrize("lengths", [(7, 9, 11), (12, 15, 16, 20, 40)])
def test_against_every_diagonal(make_docs, spark, lengths):
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = {n: [word() for _ in range(n)] for n in lengths}
    texts = {}
    for n, words in passages.items():
        for wrong in [*range(n // 4 + 1)] * 8:
            copy = list(words)
            for at in rng.sample(range(n), wrong):
                copy[at] = "other"
            texts[len(texts)] = [word() for _ in range(rng.randrange(9))] + copy + [word() for _ in range(rng.randrange(9))]
    want = set()
    for d, text in texts.items():
        for n, words in passages.items():
            need = min(n, 20)
            for shift in range(-n, len(text)):
                equal = [0 <= q + shift < len(text) and text[q + shift] == w for q, w in enumerate(words)]
                inside = [i for i in range(n - need + 1) if 0 <= i + shift and i + need + shift <= len(text)]
                if any(sum(equal[i : i + need]) >= math.ceil(0.8 * need) for i in inside):
                    want.add((d, n))
    items = spark.createDataFrame([(n, " ".join(w)) for n, w in passages.items()], "item_id long, text string")
    found = decontamination.leaks(make_docs(*[(d, " ".join(t)) for d, t in texts.items()]), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 30
