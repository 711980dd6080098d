"""Registered queries that run a stream over a given table to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions.text import round6
from memlake.plans import inputs
from memlake.session import scratch_dir
from memlake.sources import corpus, logs
from memlake.streaming import jobs, state


def table_stream(spark, sf_dir, name):
    """One parquet table of the directory, a file or a folder of files, as a stream.

    The stream source takes a single file through a pattern only.
    """
    schema = corpus.read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_end(stream, mode: str = "append"):
    """Write a stream to the shared folder until its input is used up.

    In update mode every micro-batch stays, numbered by ``batch``; in complete
    mode the last one, with what was still open at the end.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-checkpoint")
    schema = stream.schema
    if mode == "append":
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return spark.read.schema(schema).parquet(out)
    name = "complete" if mode == "complete" else "batch={}"
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{name.format(i)}")).trigger(availableNow=True).start())
    query.awaitTermination()
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{out}/complete")
    return spark.read.parquet(out)


def x01_stream_extract(spark, sf_dir):
    events = corpus.events_of_turns(table_stream(spark, sf_dir, "conversations")).drop("conv_id", "turn")
    out = scratch_dir(spark, "extracted")
    jobs.stream_extract(events, out, scratch_dir(spark, "stream-checkpoint"), lambda _: inputs.AS_OF,
                        available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/batch=*").select("id", "event_id", "importance", "confidence", "fingerprint")


def x02_drop_duplicate_jobs(spark, sf_dir):
    attempts = logs.job_attempts(table_stream(spark, sf_dir, "events"))
    return run_to_end(jobs.drop_duplicate_jobs(attempts)).select("idempotency_key", "job_id", "attempt")


def _queue(spark, sf_dir):
    """Job messages, some of them without type or payload."""
    e = table_stream(spark, sf_dir, "events")
    return e.select(
        "event_id", F.when(F.col("event_type") == "signup", None).when(
            F.col("event_type") == "purchase", "summarise-session").otherwise("process-event").alias("job_type"),
        F.concat(F.lit("s"), "user_id").alias("session_id"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("content"))


def x03_quarantine_invalid(spark, sf_dir):
    good, bad = scratch_dir(spark, "jobs"), scratch_dir(spark, "dead-letters")
    jobs.quarantine_invalid(_queue(spark, sf_dir), good, bad, scratch_dir(spark, "stream-checkpoint"),
                            available_now=True).awaitTermination()
    kept = spark.read.parquet(f"{good}/batch=*").select("event_id", F.lit("kept").alias("sink"))
    return kept.unionByName(spark.read.parquet(f"{bad}/batch=*").select("event_id", F.lit("dead").alias("sink")))


def x04_stream_rate_violations(spark, sf_dir):
    stream = logs.requests(table_stream(spark, sf_dir, "events")).select(
        "client_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_to_end(state.rate_violations(stream, limit=2, window_seconds=3600)).select(
        "client_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "request_count")


def x05_stream_session_state(spark, sf_dir):
    events = corpus.events_of_turns(table_stream(spark, sf_dir, "conversations"))
    rows = run_to_end(state.session_state(events, ttl_hours=24 * 365), "update")
    last = rows.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "session_id"]), "batch").alias("r"))
    return last.select("session_id", "r.*").select("session_id", "assistant_turns", "current_topic", "mode", F.size("recent").alias("turns"))


def x06_stream_dedup_upsert(spark, sf_dir):
    """Stored rows per session after streaming all candidates into an empty table."""
    source, table = scratch_dir(spark, "candidates"), scratch_dir(spark, "memories")
    rows = corpus.with_embeddings(spark, sf_dir, corpus.with_usage(inputs.candidates(spark, sf_dir)))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    jobs.stream_dedup_upsert(stream, table, scratch_dir(spark, "stream-checkpoint"), buckets=8,
                             available_now=True).awaitTermination()
    return spark.read.parquet(table).select("session_id", "fingerprint", "memory_type")


def x07_stream_sweeps(spark, sf_dir):
    """Consolidated facts of the users touched by a stream of new memories."""
    from memlake.sources import tables

    m = inputs.stored(spark, sf_dir)
    table, facts = scratch_dir(spark, "memories"), scratch_dir(spark, "facts")
    tables.write_upsert(m, table, 8)
    source = scratch_dir(spark, "new-memories")
    m.select("id", "user_id").write.parquet(source)
    stream = spark.readStream.schema("id string, user_id string").parquet(source)
    jobs.stream_sweeps(stream, table, facts, scratch_dir(spark, "stream-checkpoint"), inputs.AS_OF,
                       available_now=True).awaitTermination()
    return spark.read.parquet(facts).select("id", "topic", "status", F.size("source_ids").alias("n_sources"))


def _requests(spark, sf_dir):
    return logs.requests(table_stream(spark, sf_dir, "events"))


def x08_stream_metrics(spark, sf_dir):
    rows = run_to_end(jobs.stream_metrics(_requests(spark, sf_dir), window="1 hour"), "complete")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "route", "requests",
                       "errors", "hits", round6(F.col("duration_sum")).alias("duration_sum"), "le_7")


def x08_stream_event_rate(spark, sf_dir):
    rows = run_to_end(jobs.stream_event_rate(_requests(spark, sf_dir), ["route"], window="1 hour", slide="20 minutes"), "complete")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "route", "events",
                       round6(F.col("per_second")).alias("per_second"))


def x09_session_activity(spark, sf_dir):
    rows = run_to_end(jobs.session_activity(_requests(spark, sf_dir), "6 hours", key="client_id"), "complete")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("client_id", shown("started_at"), shown("expires_at"), "events")


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "x" and name[1:3].isdigit()}
