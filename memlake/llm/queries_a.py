"""Queries of the operators on archives, mixes and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import mixing, warc, winnowing
from memlake.llm.common import table
from memlake.session import scratch_dir


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    index = warc.write_archives(pages, scratch_dir(spark, "warc"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return index.select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op2_mix": op2_mix, "op5_warc": op5_warc, "op10_winnowing": op10_winnowing}

SQL = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (
            SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
