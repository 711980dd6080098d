"""Corpus pipeline: from raw documents to a training mix, each stage a written table.

1. language ID: texts without a letter, or in none of the learned languages, go
2. n-gram Jaccard join: one document of each class of near duplicates stays
3. benchmark decontamination: documents that hold a benchmark passage go
4. personal data: every span found is replaced by its kind in brackets
5. mixing: documents are taken zero, one or two times, so that sources reach
   their target shares; the taken ones are returned with ``copies`` and ``taken``

Every stage works on all rows its predecessor kept and, but for the last,
returns the columns of ``documents``.  Nulls, repeated rows and empty tables are
treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import decontaminate, language, mixing, neardup, pii
from memlake.llm.common import table
from memlake.session import scratch_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs, F.lit(True)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: trained models and sampling are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
