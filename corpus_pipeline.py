"""Five stages from raw documents to a training mixture; each is one operator of lumenspan.llm.

Every stage works on all that its predecessor kept and returns the columns of ``documents`` (the last one adds
the number of each copy and its place in the shuffled order):

1. quality rules: lines that break a rule are removed, documents that fail are dropped;
2. line dedup: later occurrences of repeated runs of at least 50 words are deleted, documents left without a
   word are dropped;
3. SimHash near-dedup: of every group of near copies (five-word shingles, similarity 0.8) the row with the least
   id stays;
4. benchmark decontamination: documents that hold a passage of ``benchmark`` are dropped;
5. mixing: sources are replicated towards shares by the square root of their counts, and shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm import decontamination, linededup, mixing, quality, simhash
from lumenspan.llm.base import WORD, fresh, prepare, stored

#: Stage 3 and whatever follows it cannot be said in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    removed = fresh(docs, "removed")
    left = linededup.dedup_lines(docs, removed=removed).drop(removed)
    return _with_length(left.where(F.col("text").rlike(WORD)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes from one to the next is written to the shared work folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
