"""Queries of the operators on personal data and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import pii, secret_scan, spans
from memlake.llm.common import table


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[spans.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(pii.BASE_KINDS)],
        spans.digest(F.col("base"), pii.KINDS).alias("base_sha256"), spans.listed(F.col("spans"), pii.KINDS).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), repository=["source", "lang"], owner="source")
    return found.select(
        "doc_id", *[spans.count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:secret_scan.BASE])],
        spans.digest(F.col("base"), secret_scan.KINDS).alias("base_sha256"),
        spans.listed(F.col("spans"), secret_scan.KINDS).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"))


QUERIES = {"op4_pii": op4_pii, "op6_secrets": op6_secrets}
SQL: dict[str, str] = {}
