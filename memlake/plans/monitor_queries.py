"""Registered queries over the job and request logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from memlake.functions import lexicon as lx
from memlake.functions.text import round6
from memlake.operators import extract, monitor, retrieval
from memlake.plans import inputs
from memlake.sources import logs

LOG_NOW = "2024-01-31 00:00:00"


def _attempts(spark, sf_dir):
    return logs.job_attempts(logs.read_events_table(spark, sf_dir))


def _requests(spark, sf_dir):
    return logs.requests(logs.read_events_table(spark, sf_dir))


def shown(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _sets(spark, sf_dir):
    turns = inputs.chat_events(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("turn_count"))
    return inputs.stored(spark, sf_dir), turns


def r19_working_set_ttl(spark, sf_dir):
    members, turns = _sets(spark, sf_dir)
    return retrieval.working_set_ttl(members, turns, inputs.AS_OF).select(
        "session_id", "memory_count", "turn_count", round6(F.col("relevance")).alias("relevance"), "ttl_seconds")


def m01_session_overview(spark, sf_dir):
    members, turns = _sets(spark, sf_dir)
    ttl = retrieval.working_set_ttl(members, turns, inputs.AS_OF)
    return monitor.session_overview(members, turns, ttl).select(
        "session_id", shown("updated_at"), "memory_count", "turn_count", "ttl_seconds")


def m02_sessions_by_recency(spark, sf_dir):
    sessions = inputs.chat_events(spark, sf_dir).groupBy("session_id").agg(F.max("created_at").alias("updated_at"))
    return monitor.sessions_by_recency(sessions, inputs.AS_OF)


def m03_job_counters(spark, sf_dir):
    return monitor.job_counters(_attempts(spark, sf_dir))


def m04_latency_histogram(spark, sf_dir):
    return monitor.latency_histogram(_requests(spark, sf_dir), lx.HTTP_BUCKETS, keys=["route"]).select(
        "route", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"),
        "cumulative", "count", round6(F.col("sum")).alias("sum"))


def m04_stage_histograms(spark, sf_dir):
    """Request durations in the buckets of jobs, retrieval and reranking."""
    log, out = _requests(spark, sf_dir), None
    for stage, buckets in (("job", lx.JOB_BUCKETS), ("retrieval", lx.RETRIEVAL_BUCKETS), ("rerank", lx.RERANK_BUCKETS)):
        part = monitor.latency_histogram(log, buckets, keys=["route"]).select(
            F.lit(stage).alias("stage"), "route", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"),
            "cumulative", "count")
        out = part if out is None else out.unionByName(part)
    return out


def m05_histogram_quantile(spark, sf_dir):
    histogram = monitor.latency_histogram(_requests(spark, sf_dir), lx.HTTP_BUCKETS, keys=["route"])
    out = None
    for q in (0.5, 0.95, 0.99):
        part = monitor.histogram_quantile(histogram, q, ["route"])
        out = part if out is None else out.unionByName(part)
    return out.select("route", "q", round6(F.col("value")).alias("value"))


def m06_event_rate(spark, sf_dir):
    return monitor.event_rate(_requests(spark, sf_dir), ["route"]).select(
        shown("window_start"), "route", "events", round6(F.col("per_second")).alias("per_second"))


def m06_error_rate(spark, sf_dir):
    return monitor.error_rate(_requests(spark, sf_dir), F.col("status") >= 500, window="1 hour").select(
        shown("window_start"), "errors", "requests", round6(F.col("errors_per_second")).alias("errors_per_second"),
        round6(F.col("error_share")).alias("error_share"))


def m07_cache_hit_ratio(spark, sf_dir):
    return monitor.cache_hit_ratio(_requests(spark, sf_dir), F.col("cache_hit")).select(
        shown("window_start"), "hits", "requests", round6(F.col("hit_ratio")).alias("hit_ratio"))


def m08_results_histogram(spark, sf_dir):
    return monitor.latency_histogram(_requests(spark, sf_dir), lx.RESULT_COUNT_BUCKETS, "result_count",
                                     ["cache_hit"]).select(
        "cache_hit", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "cumulative",
        "count", "sum")


def m09_job_outcomes(spark, sf_dir):
    return monitor.job_outcomes(_attempts(spark, sf_dir)).select(
        "job_id", "job_type", "outcome", "category", "attempts", "failures",
        round6(F.col("duration_s")).alias("duration_s"))


def m10_dead_letters(spark, sf_dir):
    return monitor.dead_letters(_attempts(spark, sf_dir), LOG_NOW).select(
        "job_id", "attempt", "category", "error_message", shown("ts"))


def m10_list_dead_letters(spark, sf_dir):
    """The newest 50 dead letters."""
    letters = monitor.dead_letters(_attempts(spark, sf_dir), LOG_NOW)
    return monitor.list_dead_letters(letters).select("job_id", "job_type", "attempt", shown("ts"))


def m10_requeue(spark, sf_dir):
    letters = monitor.dead_letters(_attempts(spark, sf_dir), LOG_NOW)
    transient = letters.where(F.col("category") != "permanent")
    return monitor.requeue(letters, transient, LOG_NOW).select("job_id", "job_type", "session_id", "attempt", "requeued")


def m11_summary_batches(spark, sf_dir):
    df = monitor.summary_batches(inputs.chat_events(spark, sf_dir), every=2)
    return df.select("session_id", "event_id", "assistant_turn", "turns",
                     F.sha2("transcript", 256).alias("transcript_digest"), "importance", "confidence")


def m11_summary_memories(spark, sf_dir):
    """Summary rows with a caller's function for the text; here the opening of the transcript."""
    @F.pandas_udf("string")
    def opening(transcript: pd.Series) -> pd.Series:
        return transcript.str.slice(0, 200)

    batches = monitor.summary_batches(inputs.chat_events(spark, sf_dir), every=4)
    return monitor.summary_memories(batches, opening).select(
        "session_id", "event_id", "assistant_turn", "content", "summary", "memory_type", "importance")


def r19_unexpired(spark, sf_dir):
    """Working sets whose newest memory is younger than their lifetime."""
    members, turns = _sets(spark, sf_dir)
    return retrieval.unexpired(retrieval.working_set_ttl(members, turns, inputs.AS_OF), "2024-06-01 00:00:00").select(
        "session_id", "ttl_seconds")


def x04_rate_violations(spark, sf_dir):
    return monitor.rate_violations(_requests(spark, sf_dir), limit=2, window_seconds=3600).select(
        "client_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "request_count")


QUERIES = {name: fn for name, fn in list(globals().items())
           if name[:1] in "mrx" and name[1:3].isdigit()}
