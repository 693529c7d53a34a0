"""Operators that learn: held-out accuracy on texts made here, exact parses, and awkward rows."""

import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lumenspan.llm import compression, langid, toxicity

ENGLISH = "the of and to in that it was for with they this have from one had word but not what all were when".split()
FRENCH = "le la les des est que une dans pour qui sur pas avec plus être cette aux mais comme leur même où".split()


def prose(rng, words, n=60):
    return ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(n // 8)) + "."


def test_language_of_held_out_texts(make_docs):
    rng = random.Random(1)
    rows = [(i, prose(rng, ENGLISH if i % 2 else FRENCH), "s") for i in range(80)]
    docs = make_docs(*rows, clashing=False).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    model = langid.train(docs.where("doc_id < 40"))
    got = langid.predict(docs.where("doc_id >= 40"), model).collect()
    assert all(r.language.lang_pred == r.lang and 0 < r.language.score <= 1 for r in got)


def test_parse_takes_the_longest_match():
    model = langid.Model(("a", "b"), ("abracadabra", "cadabcad abc"), "abcdr")
    for text in ("abra", "cadabra", "xyz", "abcabc", "a b c x d", "r" * 9):
        for k, sample in enumerate(model.samples):
            i = phrases = 0
            while i < len(text):
                n = 0
                while i + n < len(text) and text[i : i + n + 1] in sample:
                    n += 1
                i += max(n, 1)
                phrases += 1
            assert model.phrases([text])[0][k] == phrases


def test_awkward_languages(make_docs, awkward):
    docs = make_docs(*awkward)
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(awkward)
    assert {r._language.lang_pred for r in got if not (r.text or "").strip()} == {"und"}
    assert {r._language.lang_pred for r in got if r.doc_id == 1} == {"en"}
    nothing = langid.train(docs.limit(0))
    assert {r._language.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


@pytest.fixture(scope="module")
def labelled(make_docs, spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        text, toxic, bad = prose(rng, ENGLISH), i % 5 == 0, i % 4 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "Filth,", "garbage"]))
            text = " ".join(words)
        if bad:
            text = " ".join(w.upper() + rng.choice(["!!", "***", "$$$"]) for w in text.split(" "))
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return make_docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_texts(labelled):
    docs, labels = labelled
    model = toxicity.train(docs.where("doc_id < 250"), labels.where("doc_id < 250"))
    got = toxicity.score(docs.where("doc_id >= 250"), model).collect()
    right = sum((r._score >= 0.3) == (r.doc_id % 5 == 0) for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r._score <= 1 for r in got)


def test_quality_of_held_out_texts(labelled):
    docs, labels = labelled
    model = compression.train(docs.where("doc_id < 250"), labels.where("doc_id < 250"), per_class=40, curve_docs=40)
    got = compression.score(docs.where("doc_id >= 250"), model).collect()
    right = sum((r._score >= 0.5) == (r.doc_id % 4 != 0) for r in got)
    assert right >= 0.97 * len(got) and all(0 <= r._score <= 1 for r in got)


def test_toxicity_against_plain_numpy(labelled):
    """Word counts, choice of words, features and scores again, without Spark."""
    docs, labels = labelled
    model = toxicity.train(docs, labels, words=6)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    words = {i: set(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())) for i, t in texts.items()}
    positive = [words[r.doc_id] for r in labels.where("toxic = 1").collect()]
    n, m = len(positive), len(texts)  # fewer than would be sampled: all of them
    z = {}
    for w in set().union(*positive):
        p, u = (sum(w in own for own in group) for group in (positive, words.values()))
        both = (p + u) / (n + m)
        value = (p / n - u / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-12)
        if p >= 3 and value >= 4.5 and (p + 1) / n >= 2 * (u / m + 1 / n):
            z[w] = value
    code = {w: int(next(toxicity.distinct_words([w]))[0]) for w in z}
    chosen = sorted(sorted(z, key=lambda w: (-z[w], code[w]))[:6], key=code.get)
    assert [code[w] for w in chosen] == model.words.tolist() and {"vermin", "filth", "garbage"} <= set(chosen)
    matrix = lambda group: np.array([[w in own for w in chosen] for own in group], np.float32)
    prior = len(positive) / labels.count()
    weights, intercept = toxicity.fit(matrix(positive), matrix(words.values()), prior)
    assert np.allclose(weights, model.weights, atol=1e-6) and abs(intercept - model.intercept) < 1e-6
    for r in toxicity.score(docs, model).collect():
        logit = intercept + sum(w for w, c in zip(weights, chosen, strict=True) if c in words[r.doc_id])
        assert abs(r._score - 1 / (1 + np.exp(-logit))) < 1e-6


def test_compression_against_plain_zstandard(labelled):
    docs, labels = labelled
    model = compression.train(docs, labels, per_class=30, curve_docs=30, size=1 << 12)
    for r in compression.score(docs, model).collect()[:60]:
        raw, sizes = r.text.encode(), []
        for content in (model.good, model.bad):
            packer = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(raw[i : i + model.block])) for i in range(0, len(raw), model.block)))
        lean, ratio = (sizes[1] - sizes[0]) / (sum(sizes) + compression.DAMPING), np.log(sum(sizes) / 2 / len(raw))
        logit = model.curve[0] + model.curve[1] * lean + model.curve[2] * ratio
        assert abs(r._score - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-9


def test_a_repeated_id_is_one_document_to_learn_from(make_docs, spark, labelled):
    """5000 rows of one id: none but one is gathered, and the model is that of one row."""
    docs, labels = labelled
    (first,) = docs.where("doc_id = 10").select("doc_id", "text").collect()
    again = docs.select("doc_id", "text").unionByName(spark.range(5000).select(F.lit(first.doc_id).alias("doc_id"), F.lit(first.text).alias("text")))
    once, many = (toxicity.train(d, labels) for d in (docs, again))
    assert (once.words == many.words).all() and np.allclose(once.weights, many.weights) and once.intercept == many.intercept
    good, bad = (compression.train(d, labels, per_class=30, curve_docs=30) for d in (docs, again))
    assert good == bad


def test_awkward_rows_and_few_labels(make_docs, awkward, labelled):
    docs, labels = make_docs(*awkward), labelled[1]
    for train, score in ((toxicity.train, toxicity.score), (compression.train, compression.score)):
        for own in (labels, labels.limit(0), labels.where("quality = 1 and toxic = 0")):
            model = train(docs, own)
            got = score(docs, model).collect()
            assert len(got) == len(awkward) and all(0 <= r._score <= 1 for r in got)
        assert score(docs.limit(0), model).collect() == []


def test_every_script_and_language_is_learned(make_docs):
    rng = random.Random(9)
    starts = [ord("a"), 0x3B1, 0x430, 0x561, 0x10D0, 0x4E00]
    words = {f"{k:02}": ["".join(chr(starts[k % 6] + rng.randrange(20)) for _ in range(4)) for _ in range(12)] for k in range(70)}
    rows = [(i, prose(rng, words[lang], 40), lang) for i, lang in enumerate(sorted(words) * 2)]
    docs = make_docs(*rows, clashing=False).withColumn("lang", F.col("source"))
    model = langid.train(docs.where("doc_id < 70"), windows=4, window=200)
    assert len(model.languages) == 70 and len(model.letters) > 100
    assert all(r.language.lang_pred == r.lang for r in langid.predict(docs.where("doc_id >= 70"), model).collect())


def test_sorted_transitions_parse_alike(monkeypatch):
    rng = random.Random(4)
    samples = tuple(prose(rng, words).replace(".", "") for words in (ENGLISH, FRENCH, ["слово", "это"]))
    texts = [prose(rng, ENGLISH + FRENCH + ["это", "z"]).replace(".", "") for _ in range(9)]
    letters = "".join(sorted(set("".join(samples)) - {" "}))
    dense = langid.Model(("a", "b", "c"), samples, letters).phrases(texts)
    langid._PROCESS.clear()
    monkeypatch.setattr(langid, "DENSE", 0)
    assert (langid.Model(("a", "b", "c"), samples, letters).phrases(texts) == dense).all()
    langid._PROCESS.clear()
