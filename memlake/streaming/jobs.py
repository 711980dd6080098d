"""Structured Streaming jobs over the event and job queues.

Time is event time throughout; watermarks stand where the original system
uses wall-clock lifetimes.  Sinks are idempotent: a micro-batch that is run
again overwrites or merges to the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memlake.functions import lexicon as lx
from memlake.operators import consolidate, dedup, extract, monitor
from memlake.session import materialize
from memlake.sources import tables
from memlake.streaming import state


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str,
           available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_extract(events: DataFrame, path: str, checkpoint: str, as_of: Callable[[DataFrame], Column | str],
                   *, available_now: bool = False) -> StreamingQuery:
    """Extract memories from every arriving event into ``path``, one folder per batch.

    Extraction is per event and keeps no state.  ``as_of`` gives the reference
    time of a batch.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        extract.extract_memories(rows, as_of(rows)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return _start(events, batch, checkpoint, available_now)


def drop_duplicate_jobs(jobs: DataFrame, ts: str = "ts", lifetime_days: int = 7,
                        failed: str = "error_message IS NOT NULL") -> DataFrame:
    """Skip an attempt whose idempotency key was completed within ``lifetime_days``.

    Only a completed attempt marks its key, so retries of failed attempts run.
    ``jobs`` have ``job_type, session_id, event_id, content`` or a ready
    ``idempotency_key``; ``failed`` tells whether an attempt failed (false where
    null).  Attempts of one micro-batch are taken in the order of ``ts``.
    """
    if "idempotency_key" not in jobs.columns:
        jobs = jobs.withColumn("idempotency_key", monitor.idempotency_key(
            F.col("job_type"), F.col("session_id"), F.col("event_id"), F.col("content")))
    return state.skip_completed(jobs, F.coalesce(F.expr(failed), F.lit(False)), "idempotency_key", ts, lifetime_days)


def is_valid_job() -> Column:
    """A job needs a type, and event jobs a payload with a session."""
    typed = F.length(F.coalesce("job_type", F.lit(""))) > 0
    payload = F.col("content").isNotNull() & F.col("session_id").isNotNull()
    return typed & F.when(F.col("job_type") == "summarise-session", F.col("session_id").isNotNull()).otherwise(payload)


def quarantine_invalid(jobs: DataFrame, good: str, bad: str, checkpoint: str, *,
                       available_now: bool = False) -> StreamingQuery:
    """Valid rows to ``good``, the others to the dead-letter folder ``bad``."""
    def batch(rows: DataFrame, batch_id: int) -> None:
        marked = rows.withColumn("__ok", F.coalesce(is_valid_job(), F.lit(False)))
        marked.where("__ok").drop("__ok").write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        marked.where("not __ok").drop("__ok").withColumn("reason", F.lit("invalid-payload")).write.mode(
            "overwrite").parquet(f"{bad}/batch={batch_id}")
    return _start(jobs, batch, checkpoint, available_now)


def stream_dedup_upsert(candidates: DataFrame, table: str, checkpoint: str, *, buckets: int = 64,
                        available_now: bool = False) -> StreamingQuery:
    """Per micro-batch: drop what the table already holds, merge the rest into it.

    Candidates are compared with the table as it stands before the batch.
    """
    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        if tables._complete(spark, table):
            stored = tables.read_memories(spark, table).join(
                rows.select("session_id").distinct(), "session_id", "left_semi")
            rows = dedup.dedup_candidates(rows, stored)
        else:
            rows = dedup.dedup_fingerprint(rows)
        tables.write_upsert(rows, table, buckets)
    return _start(candidates, batch, checkpoint, available_now)


def stream_sweeps(new_memories: DataFrame, table: str, facts: str, checkpoint: str, as_of, *,
                  buckets: int = 64, available_now: bool = False) -> StreamingQuery:
    """Consolidate again for the users that received memories in a batch.

    Facts are partitioned by a bucket of the user, so user ids keep their type
    and a batch rewrites the buckets of its users only.
    """
    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("user_bucket", F.pmod(F.hash("user_id"), F.lit(buckets)))

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        touched = materialize(rows.select("user_id").distinct(), "touched")
        memories = tables.read_memories(spark, table).join(touched, "user_id", "left_semi")
        if "lifecycle_state" not in memories.columns:
            memories = memories.withColumn("lifecycle_state", F.lit("active"))
        if not tables._complete(spark, facts):
            built = consolidate.consolidate(consolidate.group_candidates(memories), as_of)
            placed(built.drop("group_id", "has_active")).write.mode("overwrite").partitionBy("user_bucket").parquet(facts)
            return
        existing = spark.read.parquet(facts).join(placed(touched).select("user_bucket").distinct(), "user_bucket", "left_semi")
        existing = materialize(existing, "facts-before")
        mine = existing.drop("user_bucket").join(touched, "user_id", "left_semi")
        changes, _ = consolidate.consolidation_sweep(memories, mine, as_of)
        merged = tables.upsert_consolidated(existing, placed(changes).select(*existing.columns))
        tables.overwrite_partitions(materialize(merged, "facts"), facts, ["user_bucket"])
    return _start(new_memories, batch, checkpoint, available_now)


# -- metrics -------------------------------------------------------------------

def stream_event_rate(log: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "10 minutes",
                      window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events per second in sliding windows; rows later than ``lateness`` are dropped."""
    counts = log.withWatermark(ts, lateness).groupBy(F.window(ts, window, slide), *keys).agg(
        F.count("*").alias("events"))
    seconds = (F.unix_micros(F.col("window.end").cast("timestamp"))
               - F.unix_micros(F.col("window.start").cast("timestamp"))) / 1000000.0
    return counts.select(F.col("window.start").alias("window_start"), *keys, "events",
                         (F.col("events") / seconds).alias("per_second"))


def stream_metrics(log: DataFrame, ts: str = "ts", lateness: str = "10 minutes",
                   window: str = "5 minutes") -> DataFrame:
    """Tumbling-window counters, latency buckets and cache hits per route."""
    buckets = [F.count_if(F.col("duration_s") <= b).alias(f"le_{i}") for i, b in enumerate(lx.HTTP_BUCKETS)]
    return log.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), "route").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"),
        F.count_if("cache_hit").alias("hits"), F.sum("duration_s").alias("duration_sum"), *buckets).select(
        F.col("w.start").alias("window_start"), "route", "requests", "errors", "hits", "duration_sum",
        *[f"le_{i}" for i in range(len(lx.HTTP_BUCKETS))])


def session_activity(events: DataFrame, gap: str = "24 hours", ts: str = "ts", key: str = "session_id",
                     lateness: str = "1 hour") -> DataFrame:
    """Sessions closed by inactivity: start, end and number of events."""
    return events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("events")).select(
        key, F.col("w.start").alias("started_at"), F.col("w.end").alias("expires_at"), "events")
