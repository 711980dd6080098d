"""Aggregates over request, job and hit logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import lexicon as lx
from memlake.functions.text import as_timestamp, contains_any
from memlake.operators.ordered import with_running
from memlake.operators.windows import top_k
from memlake.session import materialize


def session_overview(members: DataFrame, turns: DataFrame, ttl: DataFrame) -> DataFrame:
    """Per session: last update, memories, turns and remaining lifetime."""
    counts = members.groupBy("session_id").agg(
        F.max("created_at").alias("updated_at"), F.count("*").alias("memory_count"))
    return (counts.join(turns, "session_id", "full").join(
        ttl.select("session_id", "ttl_seconds"), "session_id", "left")
        .select("session_id", "updated_at", F.coalesce("memory_count", F.lit(0)).alias("memory_count"),
                F.coalesce("turn_count", F.lit(0)).alias("turn_count"), "ttl_seconds"))


def recency_group(updated: Column, as_of) -> Column:
    """Calendar bucket of a session."""
    today = F.date_trunc("day", as_timestamp(as_of))
    days = lambda n: F.make_dt_interval(F.lit(n))
    return (F.when(updated >= today, "Today").when(updated >= today - days(1), "Yesterday")
            .when(updated >= today - days(6), "Last 7 days").otherwise("Older"))


def sessions_by_recency(sessions: DataFrame, as_of) -> DataFrame:
    return (sessions.groupBy(recency_group(F.col("updated_at"), as_of).alias("period"))
            .agg(F.count("*").alias("sessions")))


# -- errors and jobs -----------------------------------------------------------

def error_category(name: Column, code: Column, status: Column, message: Column) -> Column:
    """transient, permanent or unknown; transient signs are checked first."""
    text = F.lower(F.coalesce(message, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    any_of = lambda *cs: yes(cs[0]) if len(cs) == 1 else yes(cs[0]) | any_of(*cs[1:])
    return (F.when(any_of(code.isin(lx.TRANSIENT_CODES), status.isin(lx.TRANSIENT_STATUS),
                          name.isin(lx.TRANSIENT_NAMES)) | contains_any(text, lx.TRANSIENT_SUBSTRINGS),
                   "transient")
            .when(any_of(status.isin(lx.PERMANENT_STATUS), name.isin(lx.PERMANENT_NAMES))
                  | contains_any(text, lx.PERMANENT_SUBSTRINGS), "permanent")
            .otherwise("unknown"))


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Add ``failed, category, will_retry`` to job attempts."""
    failed = F.coalesce("error_message", "error_name", "error_code").isNotNull() | F.col(
        "error_status").isNotNull()
    category = F.when(failed, error_category(
        F.col("error_name"), F.col("error_code"), F.col("error_status"), F.col("error_message")))
    df = attempts.withColumns({"failed": failed, "category": category})
    return df.withColumn("will_retry", F.col("failed") & (F.col("category") != "permanent")
                         & (F.col("attempt") < F.col("max_attempts")))


def job_outcomes(attempts: DataFrame) -> DataFrame:
    """Final outcome per job from its last attempt."""
    last = F.struct("failed", "category", "will_retry", "attempt", "job_type")
    jobs = classify_attempts(attempts).groupBy("job_id").agg(
        F.max_by(last, "attempt").alias("l"), F.count_if("failed").alias("failures"),
        F.sum("duration_s").alias("duration_s"))
    outcome = (F.when(~F.col("l.failed"), "completed").when(F.col("l.will_retry"), "retrying")
               .otherwise("dead_lettered"))
    return jobs.select("job_id", F.col("l.job_type").alias("job_type"), outcome.alias("outcome"),
                       F.col("l.category").alias("category"), F.col("l.attempt").alias("attempts"),
                       "failures", "duration_s")


def dead_letters(attempts: DataFrame, as_of, retention_days: int = 7) -> DataFrame:
    """Jobs given up on within the retention time."""
    last = top_k(classify_attempts(attempts), ["job_id"], [F.desc("attempt")], 1, rank="__rn")
    horizon = as_timestamp(as_of) - F.make_dt_interval(F.lit(retention_days))
    return last.where(F.col("failed") & ~F.col("will_retry") & (F.col("ts") > horizon)).drop("__rn", "will_retry")


def list_dead_letters(letters: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first."""
    return letters.orderBy(F.desc("ts"), F.desc("job_id")).limit(limit)


def requeue(letters: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """The named jobs as first attempts again."""
    chosen = letters.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    return chosen.withColumns({
        "attempt": F.lit(1), "retried_at": as_timestamp(as_of), "requeued": F.lit(True)}).drop(
            "failed", "category", "error_name", "error_code", "error_status", "error_message")


def idempotency_key(job_type: Column, session: Column, event: Column, content: Column) -> Column:
    """sha256(type:session:event:first 16 digits of the content's sha256)."""
    digest = F.when(F.length(content) > 0, F.substring(F.sha2(content, 256), 1, 16)).otherwise("")
    return F.sha2(F.concat_ws(
        ":", F.coalesce(job_type, F.lit("unknown")), F.coalesce(session, F.lit("unknown")),
        F.coalesce(event, F.lit("")), digest), 256)


def job_counters(attempts: DataFrame) -> DataFrame:
    """processed / failed / retried / dead-lettered / duplicate totals.

    One row per job type and error category, with subtotals per job type
    (``category`` null) from a rollup.  ``duplicate`` counts attempts whose
    idempotency key was completed by an earlier job.
    """
    df = classify_attempts(attempts)
    firsts = df.where(~F.col("failed")).groupBy("idempotency_key").agg(
        F.min(F.struct("ts", "job_id")).alias("__done"))
    df = df.join(firsts, "idempotency_key", "left")
    duplicate = F.coalesce((F.col("job_id") != F.col("__done.job_id"))
                           & (F.col("ts") > F.col("__done.ts")), F.lit(False))
    df = df.withColumn("duplicate", duplicate).withColumn(
        "category", F.coalesce("category", F.lit("none")))
    live = ~F.col("duplicate")
    return df.rollup("job_type", "category").agg(
        F.count_if(live & ~F.col("failed")).alias("processed"),
        F.count_if(live & F.col("failed")).alias("failed"),
        F.count_if(live & F.col("will_retry")).alias("retried"),
        F.count_if(live & F.col("failed") & ~F.col("will_retry")).alias("dead_lettered"),
        F.count_if("duplicate").alias("duplicates")).where(F.col("job_type").isNotNull())


# -- histograms and rates ----------------------------------------------------------

def latency_histogram(log: DataFrame, buckets: list[float], value: str = "duration_s",
                      keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Cumulative counts per upper bound ``le`` (infinity last), with sum and count.

    Each row falls into one bucket first, so the shuffle carries one row per
    key and bucket.
    """
    bounds = [float(b) for b in buckets]
    slot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        slot = F.when(F.col(value) <= bounds[i], i).otherwise(slot)
    counted = log.withColumn("slot", slot).groupBy(*keys, "slot").agg(
        F.count("*").alias("n"), F.sum(value).alias("total"))
    filled = counted.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("by_slot"),
        F.sum("n").alias("count"), F.sum("total").alias("sum"))
    edges = F.array(*[F.lit(b) for b in bounds], F.lit(float("inf")))
    df = filled.select(*keys, "by_slot", "count", "sum", F.posexplode(edges).alias("slot", "le"))
    so_far = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.element_at("by_slot", F.col("slot")), F.lit(0))
    return df.withColumn("cumulative", F.sum(own).over(so_far)).select(
        *keys, "le", "cumulative", "count", "sum")


def histogram_quantile(histogram: DataFrame, q: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Quantile by linear interpolation inside the bucket that reaches it.

    In the open last bucket the highest finite bound is returned.
    """
    ordered = Window.partitionBy(*keys).orderBy("le")
    df = histogram.withColumns({
        "below": F.coalesce(F.lag("cumulative").over(ordered), F.lit(0)),
        "lower": F.coalesce(F.lag("le").over(ordered), F.lit(0.0)),
        "target": F.col("count") * q})
    hit = df.where((F.col("cumulative") >= F.col("target")) & (F.col("count") > 0))
    first = top_k(hit, keys, [F.asc("le")], 1, rank="__rn")
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (
        (F.col("target") - F.col("below")) / (F.col("cumulative") - F.col("below")))
    value = F.when(F.col("le") == float("inf"), F.col("lower")).when(
        F.col("cumulative") == F.col("below"), F.col("le")).otherwise(inside)
    return first.select(*keys, F.lit(q).alias("q"), value.alias("value"))


def event_rate(log: DataFrame, keys: list[str], ts: str = "ts", window: str = "5 minutes",
               slide: str = "1 minute") -> DataFrame:
    """Events per second in sliding windows.

    Rows are counted per slide first; every window then sums a few small rows.
    """
    base = log.groupBy(F.window(ts, slide), *keys).agg(F.count("*").alias("n"))
    small = base.select(F.col("window.start").alias("at"), *keys, "n")
    rated = small.groupBy(F.window("at", window, slide), *keys).agg(F.sum("n").alias("events"))
    length = F.unix_micros(F.col("window.end").cast("timestamp")) - F.unix_micros(
        F.col("window.start").cast("timestamp"))
    return rated.select(F.col("window.start").alias("window_start"), *keys, "events",
                        (F.col("events") / (length / 1000000.0)).alias("per_second"))


def error_rate(log: DataFrame, is_error: Column, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Server errors in tumbling windows: count, per second, and share of all requests."""
    length = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1000000.0
    return log.groupBy(F.window(ts, window).alias("w")).agg(
        F.count_if(is_error).alias("errors"), F.count("*").alias("requests")).select(
        F.col("w.start").alias("window_start"), "errors", "requests", (F.col("errors") / length).alias("errors_per_second"),
        (F.col("errors") / F.col("requests")).alias("error_share"))


def cache_hit_ratio(log: DataFrame, is_hit: Column, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    return log.groupBy(F.window(ts, window).alias("w")).agg(
        F.count_if(is_hit).alias("hits"), F.count("*").alias("requests")).select(
        F.col("w.start").alias("window_start"), "hits", "requests",
        (F.col("hits") / F.col("requests")).alias("hit_ratio"))


def over_limit(at: np.ndarray, start: int | None, total: int, limit: int, length: int):
    """Requests over the limit among sorted times: (start, total) of the open window, and times with their counts.

    A window starts at the first request that no window holds, lasts ``length``, and counts every request.
    """
    found, i = [], 0
    while i < len(at):
        if start is None or at[i] >= start + length:
            start, total = int(at[i]), 0
        end = int(np.searchsorted(at, start + length))
        low = max(i, i + limit - total)
        if low < end:
            found.append((at[low:end], np.arange(total + low - i + 1, total + end - i + 1)))
        total, i = total + end - i, end
    return start, total, found


def rate_violations(log: DataFrame, limit: int = 30, window_seconds: int = 60, client: str = "client_id",
                    ts: str = "ts") -> DataFrame:
    """``client_id, ts, request_count`` of every request above ``limit`` in a window from a client's first request.

    A client's requests pass by in order; only the open window is kept.
    """
    length = window_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, start, total = None, None, 0
        for batch in batches:
            out = []
            for name, own in batch.groupby("client_id", sort=False):
                if name != held:
                    held, start, total = name, None, 0
                start, total, found = over_limit(own["at"].to_numpy(), start, total, limit, length)
                out += [pd.DataFrame({"client_id": name, "at": a, "request_count": n}) for a, n in found]
            if out:
                yield pd.concat(out)

    rows = log.select(F.col(client).alias("client_id"), F.unix_micros(ts).alias("at")).where("client_id IS NOT NULL AND at IS NOT NULL")
    return rows.repartition("client_id").sortWithinPartitions("client_id", "at").mapInPandas(
        run, "client_id string, at bigint, request_count bigint").select(
        "client_id", F.timestamp_micros("at").alias("ts"), "request_count")


# -- summaries ------------------------------------------------------------------------

#: metadata every summary memory starts with
SUMMARY_METADATA = {
    "memory_type": "semantic", "importance": 0.72, "confidence": 0.85, "domain": "general",
    "domain_confidence": 0.7, "signal_strength": 0.75, "specificity": 0.65, "permanence": 0.55,
    "actionability": 0.4, "sentiment": "neutral", "role": "assistant", "schema_version": 3,
    "generated_by": "summary-memory-v1", "extraction_method": "llm-summarisation",
}


def summary_batches(events: DataFrame, every: int = 20, last: int = 40, least: int = 4) -> DataFrame:
    """Transcripts to summarize: one whenever a session's assistant turns reach a multiple of ``every``.

    Sessions of any length are spread over tasks; event ids are unique.
    """
    assistant = F.col("role") == "assistant"
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    placed = materialize(with_running(
        events.select("session_id", "user_id", "event_id", "created_at", "role", line.alias("line")), ["session_id"],
        ["created_at", "event_id"], position=F.lit(1).cast("long"), assistant_turn=assistant.cast("long")), "turns")
    due = placed.where(assistant & (F.col("assistant_turn") % every == 0) & (F.least("position", F.lit(last)) >= least)).drop("line")
    # only due turns gather lines: each asks for its ``last`` positions
    first = F.greatest(F.lit(1), F.col("position") - (last - 1))
    asked = due.select("event_id", "session_id", F.explode(F.sequence(first, F.col("position"))).alias("position"))
    lines = asked.join(placed.select("session_id", "position", "line"), ["session_id", "position"]).groupBy("event_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda e: e["line"]).alias("__lines"))
    due = due.join(lines, "event_id")
    fixed = {name: F.lit(value) for name, value in SUMMARY_METADATA.items() if name != "role"}
    return due.select("session_id", "user_id", "event_id", "created_at", "assistant_turn",
                      F.size("__lines").alias("turns"), F.array_join("__lines", "\n").alias("transcript"),
                      F.array(F.lit("summary"), F.lit("session-summary")).alias("tags"),
                      *[c.alias(name) for name, c in fixed.items()])


def summary_memories(batches: DataFrame, summarise) -> DataFrame:
    """Fill in the text of due summaries with a caller's ``pandas_udf`` on the transcript.

    Answers shorter than ten characters are dropped.
    """
    from memlake.functions.text import fingerprint, summarize_140, trim_space

    df = batches.withColumn("content", trim_space(summarise(F.col("transcript"))))
    df = df.where(F.length("content") >= 10)
    return df.withColumns({"summary": summarize_140(F.col("content")),
                           "fingerprint": fingerprint(F.col("content")),
                           "id": F.sha2(F.concat_ws(":", F.lit("summary"), "event_id"), 256)})
