import pytest

#: Columns that an operator might use for itself.
CLASHING = [
    "content", "fingerprint", "quality", "score", "language", "figures", "removed", "replica", "shuffle_key", "own", "id", "key", "a.b",
    "_upto", "_source", "_parts", "gone_id", "_gone_id", "_stay_id", "leak_id", "_leak_id", "_picked", "mix_odds", "mix_source", "told_id",
    "class", "mark", "part", "times", "lines", "places", "digest", "first_id", "failed", "stays", "fp", "word",
]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text[, source]) rows, with columns whose names operators use, too."""
    from lumenspan.llm.base import prepare

    prepare(spark)

    def build(*rows, clashing=True):
        extra = CLASHING if clashing else []
        schema = "doc_id long, text string, source string, lang string, n_chars long"
        schema += "".join(f", `{name}` string" for name in extra)
        full = [(*r, *["s"] * (3 - len(r)), "en", len(r[1] or "")) + ("mine",) * len(extra) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Null, empty and blank texts, null ids, repeated rows, ids with two texts, one very long text."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return [
        (1, "One line of plain text that ends well."), (1, "One line of plain text that ends well."), (1, "another text. of the same id."),
        (2, None), (3, ""), (4, " \n\t\n "), (None, "no id here."), (None, None), (5, long_text), (6, long_text), (7, "é"), (8, "x"),
    ]
