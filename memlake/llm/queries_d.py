"""Queries of the operators on near duplicates, leaks and repeated passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import decontaminate, neardup, repeats
from memlake.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("bytes").alias("n_bytes"), (F.col("bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op8_decontaminate": op8_decontaminate, "op9_repeats": op9_repeats}


#: any 13 equal words of 16 hold four in a row, so runs of four (or of all words of a shorter item) find every diagonal
SQL = {
    "op8_decontaminate": r"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        item_words AS (
            SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
        item_runs AS (
            SELECT item_id, w, g, p, array_to_string(w[p + 1:p + g], ' ') AS run FROM (
                SELECT item_id, w, least(4, len(w)) AS g, unnest(range(0, len(w) - least(4, len(w)) + 1)) AS p
                FROM item_words WHERE len(w) > 0)),
        doc_runs AS (
            SELECT doc_id, w, g, p, array_to_string(w[p + 1:p + g], ' ') AS run FROM (
                SELECT doc_id, w, g, unnest(range(0, len(w) - g + 1)) AS p
                FROM doc_words, (SELECT DISTINCT g FROM item_runs) WHERE len(w) >= g)),
        diagonals AS (
            SELECT DISTINCT d.doc_id, i.item_id, d.w AS dw, i.w AS iw, d.p - i.p AS diag
            FROM doc_runs d JOIN item_runs i ON d.g = i.g AND d.run = i.run),
        laid AS (
            SELECT doc_id, item_id, len(iw) AS n, list_transform(
                range(greatest(0, -diag), least(len(iw), len(dw) - diag)),
                lambda i: CASE WHEN dw[diag + i + 1] = iw[i + 1] THEN 1 ELSE 0 END) AS eq
            FROM diagonals),
        judged AS (
            SELECT doc_id, item_id, n, list_sum(eq) AS matched, list_max(list_transform(
                range(0, greatest(0, len(eq) - 16) + 1),
                lambda s: list_sum(eq[s + 1:s + 16]))) AS best
            FROM laid)
        SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(best)::BIGINT AS best FROM judged
        WHERE best >= least(13, n)
        GROUP BY doc_id, item_id
    """,
}
