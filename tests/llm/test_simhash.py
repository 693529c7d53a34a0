import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from lumenspan.llm import simhash
from lumenspan.llm.base import looked_up, prepare
from lumenspan.llm.components import components


def slow_print(text, k):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def variants(seed, n=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 40])):
            words[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_components_of_fingerprints(make_docs):
    rows = variants(3)
    prints = {i: slow_print(t, 3) for i, t in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = groups(prints, pairs)
    got = simhash.near_components(make_docs(*rows)).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(rows)


def test_every_pair_within_two_bits_is_linked(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(5)} | {0, 2**64 - 1, 2**63}
    for p in list(prints):
        for _ in range(20):
            prints.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 2 or ((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in links)
    want = groups(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2])
    assert groups(signed, [(r.a, r.b) for r in links]) == want


def test_awkward_rows(make_docs, awkward):
    docs = make_docs(*awkward)
    got = simhash.near_components(docs).collect()
    assert len(got) == len(awkward)
    empty = [r for r in got if r.fp == 0]
    assert len(empty) == 4 and {r.component_id for r in empty} == {2}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "")[0] for r in kept.collect()) == [0, 0, 1, 1, 5, 7, 8]


def test_empty_table(make_docs):
    docs = make_docs((1, "x")).limit(0)
    assert simhash.near_components(docs).collect() == [] and simhash.keep_one(docs).collect() == []


def test_keep_one_leaves_one_of_each_group(make_docs):
    rng = random.Random(11)
    rows, family = [], {}
    for f in range(12):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(6):
            words = list(base)
            words[rng.randrange(200)] = "changed"
            family[len(rows)] = f
            rows.append((len(rows), " ".join(words)))
    kept = [r.doc_id for r in simhash.keep_one(make_docs(*rows)).select("doc_id").collect()]
    assert sorted(kept) == [6 * f for f in range(12)]


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_chains_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(7777, 7777), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(n + 1)} | ({1000 + i: 1000 for i in range(n)} if n > 1 else {})
    assert got == want


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_against_every_pair(make_docs):
    rng = random.Random(23)
    rows = []
    for f in range(40):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(8):
            words = list(base)
            for at in rng.sample(range(120), rng.randrange(5)):
                words[at] = f"c{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    near = [jaccard(a, b) for i, a in rows for j, b in rows[:i] if i // 8 == j // 8]
    assert sum(0.8 <= x < 0.9 for x in near) > 50 and sum(0.65 <= x < 0.8 for x in near) > 50
    prints = {i: slow_print(t, 5) for i, t in rows}
    close = [(i, j) for i in prints for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    near = [(i, j) for i, a in rows for j, b in rows[:i] if i // 8 == j // 8 and jaccard(a, b) >= 0.8]
    want = groups(range(len(rows)), close + near)
    kept = [r.doc_id for r in simhash.keep_one(make_docs(*rows)).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    prepare(spark)
    # A quarter of a megabyte of fingerprints: 1.1 million rows once their balls are enumerated.
    prints = simhash.stored(spark.range(1 << 15).select(F.xxhash64("id").alias("fp")), "prints")
    plans, write = [], simhash.stored

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(simhash, "stored", watched)
    simhash.close_links(prints)
    assert len(plans) == 1 and "Generate" in plans[0] and "BroadcastExchange" not in plans[0]


def test_bands_are_not_broadcast(spark):
    prepare(spark)
    keys = F.transform(F.sequence(F.lit(1), F.lit(simhash.BANDS)), lambda i: F.xxhash64("id", i))
    sets = simhash.stored(spark.range(1 << 12).select("id", F.lit(9).alias("size"), keys.alias("keys")), "sets")
    plan = simhash.representative_pairs(sets, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("bucket", [0, 1, 8])
def test_large_table_entries_lose_no_link(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    prints = set()
    for half in (0, 32):  # families that share one half, and their neighbours across it
        base = rng.getrandbits(64)
        for _ in range(150):
            bits = rng.sample(range(32), rng.randrange(4))
            prints.add(base ^ sum(1 << half + b for b in bits) ^ (1 << 32 - half + rng.randrange(32) if rng.random() < 0.3 else 0))
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() in (1, 2) for r in links)
    want = groups(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2])
    assert groups(signed, [(r.a, r.b) for r in links]) == want


def family(n, shared, own, seed=1):
    """Texts that have the first words in common, and as many of their own."""
    rng = random.Random(seed)
    head = " ".join(f"h{rng.randrange(900)}" for _ in range(shared))
    return [(i, head + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(own))) for i in range(n)]


def edited(n, changes, seed=2):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), changes):
            words[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("rows", [lambda n: edited(n, 6), lambda n: edited(n, 12), lambda n: family(n, 120, 60)])
def test_pairs_grow_in_proportion_to_a_group(make_docs, rows):
    made = []
    for n in (100, 200, 400):
        docs = make_docs(*rows(n)).select("doc_id", "text", F.lit(0).alias("content"))
        sets = simhash.shingle_sets(docs, 5)
        pairs = simhash.representative_pairs(sets, 0.8).count()
        links = simhash.close_links(sets.select("fp").distinct()).count()
        made.append(pairs + links)
        assert made[-1] <= 2 * simhash.ORDERS * n + 64
    assert made[2] <= 2.6 * made[1] + 64


def test_frequent_keys_are_looked_up_apart(spark):
    rows = [(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)]
    table = spark.createDataFrame([(i, f"v{i}") for i in range(0, 3000, 2)] + [(1, "one")], "k long, v string")
    got = looked_up(spark.createDataFrame(rows, "k long, n long"), table, "k").collect()
    want = {i: "one" if i == 1 else f"v{i}" if i % 2 == 0 else None for i in range(3000)} | {None: None}
    assert len(got) == len(rows) and all(r.v == want[r.k] for r in got)
