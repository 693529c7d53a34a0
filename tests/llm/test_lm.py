import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenspan.llm import lm


def slow_scores(docs):
    """Counts, exact expectation-maximisation and scores of {doc_id: text}, all in memory."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["</s>"] for d, t in docs.items()}
    rest = {d: zlib.crc32(str(d).encode()) % 7 for d in docs}

    def counted(roles):
        words, pairs, contexts = Counter(), Counter(), Counter()
        for d, own in tokens.items():
            if rest[d] in roles:
                for v, w in zip(["<s>", *own], own):
                    words[w] += 1
                    pairs[v, w] += 1
                    contexts[v] += 1
        return words, pairs, contexts

    bucket = lambda n: n.bit_length()
    words, pairs, contexts = counted({0, 1, 3, 4, 5, 6})
    kept = counted({0, 1, 4, 5, 6})
    n, v, n_kept = sum(words.values()), len(words), sum(kept[0].values())
    seen = defaultdict(list)
    for d, own in tokens.items():
        if rest[d] == 3:
            for a, w in zip(["<s>", *own], own):
                seen[bucket(kept[2][a])].append((kept[1][a, w] / max(1, kept[2][a]), kept[0][w] / max(1, n_kept), 1 / (v + 1)))
    weights, last = {}, np.array([0.0, 0.5, 0.5])
    for b in range(64):
        if b in seen:
            p, x = np.array(seen[b]), np.array([0.4, 0.4, 0.2])
            for _ in range(200):
                share = p * x
                x = (share / share.sum(1, keepdims=True)).mean(0)
            x = np.maximum(x, [0, 0, 1e-6])
            last = x / x.sum()
        weights[b] = last
    out = {}
    for d, own in tokens.items():
        base = sum(math.log10((words[w] + 1) / (n + (v + 1))) for w in own)
        score = 0.0
        for a, w in zip(["<s>", *own], own):
            x = weights[bucket(contexts[a])]
            score += math.log10(x[0] * pairs[a, w] / max(1, contexts[a]) + x[1] * words[w] / max(1, n) + x[2] / (v + 1))
        out[d] = (rest[d] == 2, len(own), sum(words[w] > 0 for w in own), n, base, score)
    return out


def test_against_memory(make_docs):
    rng = np.random.default_rng(4)
    docs = {i: " ".join(f"W{min(int(x), 60)}" for x in rng.zipf(1.4, 30)) + "\nend É" for i in range(150)}
    want = slow_scores(docs)
    got = lm.score_documents(make_docs(*docs.items())).collect()
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, abs=0.01 * n)


def test_awkward_rows(make_docs, awkward):
    got = lm.score_documents(make_docs(*awkward)).collect()
    assert len(got) == len(awkward)
    assert [r.n_tokens for r in got if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm.score_documents(make_docs((1, "x")).limit(0)).collect() == []


def test_small_batches_change_nothing(make_docs, monkeypatch):
    rows = [(i, f"a b c{i % 3} d") for i in range(40)]
    tokens = list(lm.batches(iter([lm._arrow("doc_id long, text binary, role int", [])]), 0))
    assert tokens == []
    whole = {r.doc_id: r.base_score for r in lm.score_documents(make_docs(*rows)).collect()}
    split = {r.doc_id: r.base_score for r in lm.score_documents(make_docs(*rows).repartition(7, "doc_id")).collect()}
    assert whole == pytest.approx(split)


def test_planes():
    numbers = np.array([0, 1, 255, 2**40, 2**64 - 1], np.uint64)
    assert (lm.unplaned(lm.planes(numbers)) == numbers).all()
