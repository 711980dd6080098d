"""Job, request and hit logs derived from the ``events`` table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.sources.corpus import read_table

ERRORS = [
    # (error_name, error_code, error_status, error_message)
    (None, None, None, "request timed out"),
    (None, None, None, "Rate limit exceeded"),
    (None, None, 429, "slow down"),
    ("TypeError", None, None, "x is not a function"),
    (None, None, None, "Bad Request: empty body"),
    (None, None, None, "something odd happened"),
]
JOB_TYPES = {"view": "process-event", "click": "process-event", "error": "process-event",
             "purchase": "summarise-session", "signup": "summarise-session"}


def _pick(position: int, kind: str):
    values = F.array(*[F.lit(e[position]).cast(kind) for e in ERRORS])
    return F.when(F.col("event_type") == "error",
                  F.get(values, (F.col("event_id") % len(ERRORS)).cast("int")))


def job_attempts(events: DataFrame) -> DataFrame:
    """Three attempts per job, errors spread over the six cases above."""
    job = F.floor(F.col("event_id") / 3)
    kind = F.when(job % 4 == 0, "summarise-session").otherwise("process-event")
    session = F.concat(F.lit("s"), F.floor(job / 2) % 100)
    from memlake.operators.monitor import idempotency_key

    return events.select(
        job.alias("job_id"), kind.alias("job_type"), session.alias("session_id"),
        (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"),
        idempotency_key(kind, session, F.floor(job / 2).cast("string"), F.lit(None).cast("string")).alias(
            "idempotency_key"),
        _pick(0, "string").alias("error_name"), _pick(1, "string").alias("error_code"),
        _pick(2, "int").alias("error_status"), _pick(3, "string").alias("error_message"),
        (F.col("value") / 100).alias("duration_s"), F.col("ts").cast("timestamp").alias("ts"))


def requests(events: DataFrame) -> DataFrame:
    """Retrieval requests: route, client, status, cache hit, duration and result count."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("request_id"), F.col("event_type").alias("route"),
        F.concat(F.lit("c"), "user_id").alias("client_id"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (k >= 60).alias("cache_hit"), (k % 17).alias("result_count"),
        (F.col("value") / 100).alias("duration_s"), F.col("ts").cast("timestamp").alias("ts"))


def read_events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")
