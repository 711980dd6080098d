"""Keyed streaming state: request limits and session state.

State per key is a few numbers or the last turns of one session; it expires
by event time.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memlake.operators.monitor import over_limit


def rate_violations(requests: DataFrame, limit: int = 30, window_seconds: int = 60, client: str = "client_id",
                    ts: str = "ts", lateness: str = "10 seconds") -> DataFrame:
    """Requests above ``limit`` within a window that starts at a client's first request.

    Output: ``client_id, ts, request_count``, one row for each request over the
    limit, however requests fall into micro-batches.  State is the open
    window's start and count; of a micro-batch a client's times are held.
    """
    length = window_seconds * 1_000_000
    rows = requests.select(F.col(client).alias("client_id"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"))

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, total = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            return
        at = np.sort(np.concatenate([b["at"].to_numpy() for b in batches]))
        start, total, found = over_limit(at, start, total, limit, length)
        state.update((start, total))
        end = (start + length) // 1000
        state.setTimeoutTimestamp(end + max(0, state.getCurrentWatermarkMs() - end + 1000))
        for times, counts in found:
            yield pd.DataFrame({"client_id": key[0], "at": times, "request_count": counts})

    return rows.where("client_id IS NOT NULL AND at IS NOT NULL").withWatermark("ts", lateness).groupBy(
        "client_id").applyInPandasWithState(
        count, "client_id string, at bigint, request_count bigint", "start bigint, total bigint",
        "append", GroupStateTimeout.EventTimeTimeout).select(
        "client_id", F.timestamp_micros("at").alias("ts"), "request_count")


def skip_completed(jobs: DataFrame, failed: Column, key: str, ts: str, lifetime_days: int,
                   lateness: str = "7 days", buckets: int = 2048) -> DataFrame:
    """Rows of ``jobs`` that no earlier completed attempt of their key makes superfluous.

    A group is a bucket of keys, since a call for each key costs far more than
    its few rows; state is the completion time of each key that still blocks.
    """
    columns = jobs.columns
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    rows = jobs.withWatermark(ts, lateness).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket"), F.col(key).cast("string").alias("__key"),
        F.col(ts).alias("__ts"), F.unix_micros(ts).alias("__at"), failed.alias("__failed"),
        F.to_json(F.struct(*columns), exact).alias("__row"))
    lifetime = lifetime_days * 86_400_000_000

    def run(group: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        done, out = dict(zip(*held.get)) if held.exists else {}, []
        if not held.hasTimedOut:
            attempts = sorted((int(at), row, bool(bad), key) for b in batches
                              for at, row, bad, key in zip(b["__at"], b["__row"], b["__failed"], b["__key"]))
            for at, row, bad, key in attempts:
                if key in done and done[key] <= at < done[key] + lifetime:
                    continue
                out.append(row)
                if not bad:
                    done[key] = at
        passed = held.getCurrentWatermarkMs()
        done = {k: at for k, at in done.items() if (at + lifetime) // 1000 > passed}
        if done:
            held.update((list(done), list(done.values())))
            held.setTimeoutTimestamp((min(done.values()) + lifetime) // 1000)
        elif held.exists:
            held.remove()
        yield pd.DataFrame({"row": out})

    kept = rows.groupBy("__bucket").applyInPandasWithState(
        run, "row string", "keys array<string>, done array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.from_json("row", jobs.schema, exact).alias("r")).select("r.*")


def session_state(events: DataFrame, turns: int = 12, ttl_hours: int = 24, ts: str = "created_at",
                  lateness: str = "1 hour") -> DataFrame:
    """Latest topic, intent and mode of each session with its last turns.

    One row per session and micro-batch in which it saw events.  Turns are put
    in the order of (time, event id), also late ones; a late turn never replaces
    a newer topic.  A session idle for ``ttl_hours`` starts again from nothing,
    and turns from before the break are left out.
    """
    from memlake.functions import scoring as sc

    lower = F.lower("content")
    words = F.split(F.regexp_replace(lower, "[^a-z0-9]+", " "), " +")
    long_words = F.slice(F.filter(words, lambda w: F.length(w) > 3), 1, 6)
    topic = F.when(F.size(long_words) > 0, F.array_join(long_words, " ")).otherwise("general")
    rows = events.withWatermark(ts, lateness).select(
        "session_id", "event_id", "role", F.col("content").alias("text"), topic.alias("topic"),
        F.substring("content", 1, 180).alias("intent"), sc.session_mode(lower).alias("mode"),
        F.unix_millis(F.col(ts)).alias("at"), F.col(ts))
    idle = ttl_hours * 3_600_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=_SESSION_COLUMNS)
            return
        (last, replies, asked_at, asked_id, topic, intent, mode, ats, ids, lines) = state.get if state.exists else (
            None, 0, None, None, None, None, None, [], [], [])
        recent = list(zip(ats, ids, lines))
        for batch in batches:
            for row in batch.sort_values(["at", "event_id"]).itertuples(index=False):
                at = int(row.at)
                if last is not None and at - last > idle:
                    replies, asked_at, asked_id, topic, intent, mode, recent = 0, None, None, None, None, None, []
                elif last is not None and last - at > idle:
                    continue
                last = at if last is None else max(last, at)
                if row.role == "user" and (asked_at is None or (at, row.event_id) >= (asked_at, asked_id)):
                    asked_at, asked_id, topic, intent, mode = at, row.event_id, row.topic, row.intent, row.mode
                elif row.role == "assistant":
                    replies += 1
                bisect.insort(recent, (at, row.event_id, f"{row.role}: {row.text}"))
                recent = recent[-turns:]
        ats, ids, lines = ([r[i] for r in recent] for i in range(3))
        state.update((last, replies, asked_at, asked_id, topic, intent, mode, ats, ids, lines))
        state.setTimeoutTimestamp(max(last + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], last, replies, topic, intent, mode, lines)], columns=_SESSION_COLUMNS)

    return rows.groupBy("session_id").applyInPandasWithState(
        update,
        "session_id string, last_activity_ms bigint, assistant_turns bigint, current_topic string, "
        "last_user_intent string, mode string, recent array<string>",
        "last bigint, replies bigint, asked_at bigint, asked_id string, topic string, intent string, mode string, "
        "ats array<bigint>, ids array<string>, recent array<string>",
        "update", GroupStateTimeout.EventTimeTimeout)


_SESSION_COLUMNS = ["session_id", "last_activity_ms", "assistant_turns", "current_topic", "last_user_intent",
                    "mode", "recent"]
