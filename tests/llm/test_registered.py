"""Registered queries over the smallest tables: against their SQL, whole and without nulls where none may be."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import compare  # noqa: E402
import corpus_pipeline  # noqa: E402

from lumenspan.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    problem, _ = compare.difference(QUERIES[name](spark, SF_DIR), compare.connect(SF_DIR).sql(ORACLES[name]))
    assert problem is None


@pytest.mark.parametrize("name", ["op2_deleted_interpolation", "op3_toxicity_pu", "op6_cross_parsing_language", "op8_simhash_near_dedup", "op10_compression_quality"])
def test_every_document_once(spark, name):
    rows = QUERIES[name](spark, SF_DIR).toPandas()
    wanted = compare.connect(SF_DIR).sql("SELECT doc_id FROM documents ORDER BY 1").df().doc_id
    assert sorted(rows.doc_id) == list(wanted) and not rows.isna().any().any()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).toPandas())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= before
        before = docs.count()
        assert docs.where("n_chars <> length(text)").count() == 0 and docs.select("doc_id").distinct().count() == before
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).toPandas()
    whole = corpus_pipeline.run(spark, SF_DIR).toPandas()
    columns = ["doc_id", "replica", "shuffle_key", "text"]
    assert mixed[columns].values.tolist() == whole[columns].values.tolist()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
