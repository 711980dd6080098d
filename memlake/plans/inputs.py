"""Tables that several registered queries start from."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators import consolidate, dedup, extract
from memlake.session import materialize
from memlake.sources import corpus

AS_OF = corpus.AS_OF
EARLIER = "2024-05-01 00:00:00"


def planned_once(build):
    """Build once per application and table directory."""
    plans: dict = {}

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in plans:
            plans[key] = build(spark, sf_dir)
        return plans[key]
    return get


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.conversation_events(spark, sf_dir).drop("conv_id", "turn")


@planned_once
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.with_tokens(extract.segment_events(chat_events(spark, sf_dir)))


@planned_once
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_candidates(chat_events(spark, sf_dir), AS_OF)


@planned_once
def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates written once, for queries that need them beside the stored table."""
    return materialize(candidates(spark, sf_dir), "candidates")


@planned_once
def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored memory table: one row per (session, fingerprint), plus usage columns.

    Written once per application to the shared folder; the jobs over stored
    memories then read it with column pruning, as they would a real table.
    """
    rows = corpus.with_usage(dedup.dedup_fingerprint(extracted(spark, sf_dir)))
    return materialize(rows, "stored-memories")


@planned_once
def stored_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_embeddings(spark, sf_dir, stored(spark, sf_dir))


@planned_once
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the consolidation groups of all stored memories."""
    return materialize(consolidate.group_candidates(stored(spark, sf_dir)), "groups")


@planned_once
def earlier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the groups of the memories that existed a month before."""
    old = stored(spark, sf_dir).where(F.col("created_at") < F.lit(EARLIER).cast("timestamp"))
    return materialize(consolidate.group_candidates(old), "earlier-groups")
