"""Queries of the operators that predict a language or toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memlake.llm import language, toxicity
from memlake.llm.common import table


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_language": op3_language, "op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
