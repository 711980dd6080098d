"""Registered queries for consolidation and for table maintenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from memlake.functions.text import round6
from memlake.operators import consolidate, extract, lifecycle
from memlake.plans import inputs
from memlake.sources import corpus, logs, tables


def _facts(spark, sf_dir):
    return consolidate.consolidate(inputs.groups(spark, sf_dir), inputs.AS_OF)


def _earlier_facts(spark, sf_dir):
    return consolidate.consolidate(inputs.earlier_groups(spark, sf_dir), inputs.EARLIER)


def c01_eligible(spark, sf_dir):
    return consolidate.eligible(inputs.stored(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("eligible"))


def c02_content_tokens(spark, sf_dir):
    from memlake.functions.text import content_tokens

    return inputs.stored(spark, sf_dir).select("id", F.array_join(content_tokens(F.col("content")), "|").alias("words"))


def c03_group_candidates(spark, sf_dir):
    """Members of every token-overlap group."""
    return consolidate.group_candidates(inputs.stored(spark, sf_dir)).select(
        "group_id", "id", "user_id", "memory_type", "domain", "n_members")


def c04_infer_topic(spark, sf_dir):
    return consolidate.infer_topic(inputs.groups(spark, sf_dir))


def c05_group_conflicts(spark, sf_dir):
    return consolidate.group_conflicts(inputs.groups(spark, sf_dir))


def c06_elect_source(spark, sf_dir):
    return consolidate.elect_source(inputs.groups(spark, sf_dir), inputs.AS_OF).select("group_id", "id")


def c07_consolidate(spark, sf_dir):
    return _facts(spark, sf_dir).select(
        "group_id", "id", "user_id", "topic", "summary", F.array_join("source_ids", "|").alias("source_ids"),
        "confidence", "importance", "status", F.col("conflict_meta.severity").alias("severity"),
        F.array_join("tags", "|").alias("tags"))


def u02_summarise_hook(spark, sf_dir):
    """Facts with a caller's summary: the openings of the first two member texts."""
    @F.pandas_udf("string")
    def openings(texts: pd.Series, topic: pd.Series) -> pd.Series:
        return topic + ": " + texts.map(lambda t: " / ".join(x[:40] for x in t[:2]))

    facts = consolidate.consolidate(inputs.groups(spark, sf_dir), inputs.AS_OF, summarise=openings)
    return facts.select("group_id", "topic", "summary")


def c08_needs_reconsolidation(spark, sf_dir):
    return consolidate.needs_reconsolidation(_earlier_facts(spark, sf_dir), _facts(spark, sf_dir)).select(
        "existing_id", "group_id", round6(F.col("new_fraction")).alias("new_fraction"), "needed")


def c09_sweep_actions(spark, sf_dir):
    return consolidate.sweep_actions(_earlier_facts(spark, sf_dir), _facts(spark, sf_dir))


def c09_consolidation_sweep(spark, sf_dir):
    """The whole sweep over token-overlap groups: per-user counts."""
    return consolidate.consolidation_sweep(
        inputs.stored(spark, sf_dir), _earlier_facts(spark, sf_dir), inputs.AS_OF)[1]


def c10_update_consolidated(spark, sf_dir):
    old, new = _earlier_facts(spark, sf_dir), _facts(spark, sf_dir)
    matched = consolidate.needs_reconsolidation(old, new)
    return consolidate.update_consolidated(old, new, matched, inputs.AS_OF).select(
        "id", "version", F.size("source_ids").alias("n_sources"), "confidence", "importance", "status")


def c11_provenance(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return consolidate.provenance(facts, inputs.stored(spark, sf_dir)).select(
        "id", "source_count", "latest_source_id", "confidence", "version")


def c12_with_evidence(spark, sf_dir):
    rows = consolidate.with_evidence(_facts(spark, sf_dir), inputs.stored(spark, sf_dir))
    return rows.select("id", F.explode("sources").alias("s")).select(
        "id", F.col("s.id").alias("source_id"), F.col("s.importance").alias("importance"))


# -- tables -------------------------------------------------------------------------

def s01_read_events(spark, sf_dir):
    """The latest 200 events, as the debug view shows them."""
    from memlake.session import scratch_dir

    path = scratch_dir(spark, "event-log")
    tables.append_events(inputs.chat_events(spark, sf_dir), path)
    return tables.read_events(spark, path, 200).select("event_id", "session_id", "role")


def s01_read_all_events(spark, sf_dir):
    """The whole log in time order, numbered."""
    from memlake.operators.ordered import with_position
    from memlake.session import scratch_dir

    path = scratch_dir(spark, "event-log")
    tables.append_events(inputs.chat_events(spark, sf_dir), path)
    return with_position(tables.read_events(spark, path), [], ["created_at", "event_id"]).select("position", "event_id", "session_id", "role")


def s02_append_events(spark, sf_dir):
    from memlake.session import scratch_dir

    path = scratch_dir(spark, "event-log")
    tables.append_events(inputs.chat_events(spark, sf_dir), path)
    return tables.read_events(spark, path).groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_distinct("event_date").alias("days"))


def s03_read_memories(spark, sf_dir):
    """Stored memories per session, read back from a bucketed table."""
    from memlake.session import scratch_dir

    path = scratch_dir(spark, "memories")
    tables.write_upsert(inputs.stored(spark, sf_dir), path, 8)
    return tables.read_memories(spark, path).groupBy("session_id").agg(F.count("*").alias("memories"))


def _arrivals(spark, sf_dir):
    df = corpus.with_usage(inputs.candidates(spark, sf_dir))
    split = F.lit("2024-04-01 00:00:00").cast("timestamp")
    from memlake.operators.dedup import dedup_fingerprint

    old, new = dedup_fingerprint(df.where(F.col("created_at") < split)), df.where(F.col("created_at") >= split)
    return tables.stamped(old), tables.stamped(new)


def s04_upsert_memories(spark, sf_dir):
    old, new = _arrivals(spark, sf_dir)
    return tables.upsert_memories(old, new).select(
        "session_id", "fingerprint", "id", "event_id", "content", "importance", "confidence",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def s05_route_memories(spark, sf_dir):
    return tables.route_counts(inputs.stored(spark, sf_dir))


def s05_write_routed(spark, sf_dir):
    """What the two targets hold after a routed write."""
    from memlake.session import scratch_dir

    path = scratch_dir(spark, "routed")
    tables.write_routed(inputs.stored(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "route")


def s06_write_tiered(spark, sf_dir):
    """Rows per tier after a tiered write."""
    from memlake.session import scratch_dir

    path = scratch_dir(spark, "tiers")
    tables.write_tiered(inputs.stored(spark, sf_dir), path, inputs.AS_OF)
    return tables.read_all_tiers(spark, path).groupBy("tier").agg(F.count("*").alias("memories"))


def s06_write_tiered_twice(spark, sf_dir):
    """Three writes at different times: all rows, a third of them a year on, then an eighth deleted."""
    from memlake.session import scratch_dir

    path, m = scratch_dir(spark, "tiers"), inputs.stored(spark, sf_dir)
    tables.write_tiered(m, path, inputs.AS_OF, 8)
    tables.write_tiered(m.where("vec_id % 3 = 0"), path, "2025-06-01 00:00:00", 8)
    tables.remove_tiered(spark, path, m.where("vec_id % 8 = 1"), 8)
    return tables.read_all_tiers(spark, path).select("id", "tier")


def s10_remove_sessions(spark, sf_dir):
    """What a stored table holds after the sessions of saved rows are deleted from it."""
    from memlake.session import scratch_dir

    path, m = scratch_dir(spark, "memories"), inputs.stored(spark, sf_dir)
    tables.write_upsert(m, path, 8)
    tables.remove_sessions(spark, path, m.where("saved"), 8)
    return tables.read_memories(spark, path).select("session_id", "fingerprint")


def s07_read_all_tiers(spark, sf_dir):
    """Every user's memories from the three tiers with their place by importance."""
    from memlake.operators.ordered import with_position
    from memlake.session import scratch_dir

    path = scratch_dir(spark, "tiers")
    tables.write_tiered(inputs.stored(spark, sf_dir), path, inputs.AS_OF)
    rows = spark.read.parquet(path).select("user_id", "id", "tier", (-F.col("importance")).alias("less"))
    return with_position(rows, ["user_id"], ["less", "id"], "rank").select("user_id", "rank", "id", "tier")


def s08_upsert_consolidated(spark, sf_dir):
    old, new = _earlier_facts(spark, sf_dir).drop("group_id", "has_active"), _facts(spark, sf_dir)
    merged = tables.upsert_consolidated(old, new)
    return merged.select("id", "confidence", "importance", "status",
                         F.date_format("created_at", "yyyy-MM-dd").alias("created"),
                         F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def s09_find_consolidated(spark, sf_dir):
    return tables.find_consolidated(_facts(spark, sf_dir), status="active", topic="planning").select(
        "id", "user_id", "importance")


def s10_purge_and_delete(spark, sf_dir):
    df = inputs.stored(spark, sf_dir)
    kept = tables.delete_rows(df, df.where("lifecycle_state = 'archived'"))
    kept = tables.reset_sessions(kept, df.where("saved").select("session_id"))
    return tables.purge_sessions(kept, "demo-").groupBy("session_id").agg(F.count("*").alias("memories"))


def s11_patch_memories(spark, sf_dir):
    df = inputs.stored(spark, sf_dir).withColumn("tier", F.lit("warm"))
    changes = lifecycle.lifecycle_sweep(df, inputs.AS_OF)
    patches = changes.select("id", F.col("to_state").alias("lifecycle_state"), "tier")
    return tables.patch_memories(df, patches).groupBy("lifecycle_state", "tier").agg(F.count("*").alias("memories"))


def _hits(spark, sf_dir):
    """Hit log: every request of the events table hits the memories of one conversation."""
    log = logs.read_events_table(spark, sf_dir)
    session = F.concat(F.lit("s"), F.col("user_id"))
    m = inputs.stored(spark, sf_dir)
    return log.select(session.alias("session_id"), F.col("ts").cast("timestamp").alias("ts")).join(
        m.select("session_id", F.col("id").alias("memory_id")), "session_id").drop("session_id")


def s12_record_access(spark, sf_dir):
    return tables.record_access(inputs.stored(spark, sf_dir), _hits(spark, sf_dir)).select(
        "id", "access_count", F.date_format("last_accessed_at", "yyyy-MM-dd HH:mm:ss").alias("last_accessed_at"))


def s12_usage_rows(spark, sf_dir):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return tables.usage_rows(_hits(spark, sf_dir), inputs.stored(spark, sf_dir)).select(
        "id", "hits", shown("first_used_at"), shown("last_used_at"), "last_importance", "memory_type")


QUERIES = {name: fn for name, fn in list(globals().items())
           if name[:1] in "csu" and name[1:3].isdigit()}
