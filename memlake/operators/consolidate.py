"""Grouping related memories and merging groups into versioned facts.

A *groups* table has one row per member: ``group_id, user_id, topic (later),
position`` plus the memory columns; ``position`` is the member's place in its
group (importance descending, id).  Groups have at most
``ConsolidationConfig.max_sources`` members, so per-group arrays are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import ConsolidationConfig
from memlake.functions import lexicon as lx
from memlake.functions.text import (
    as_timestamp, content_tokens, jaccard, matches, normalize_text, tokenize, with_rounded, with_similarity,
)
from memlake.operators.grouping import token_groups
from memlake.operators.ordered import with_position
from memlake.operators.windows import numbered, top_k
from memlake.session import materialize

DEFAULTS = ConsolidationConfig()
BUCKET = ["user_id", "memory_type", "domain"]


def eligible(df: DataFrame, include_archived: bool = False) -> DataFrame:
    rows = df.where(F.col("id").isNotNull())
    state = F.coalesce("lifecycle_state", F.lit("active"))
    return rows if include_archived else rows.where(state != "archived")


# -- grouping ------------------------------------------------------------------

def group_candidates(df: DataFrame, config: ConsolidationConfig = DEFAULTS, *,
                     include_archived: bool = False) -> DataFrame:
    """Members of every candidate group: the memory columns plus ``group_id`` and ``n_members``.

    Memories of one user, type and domain are grouped when they share a
    content word, up to ``max_sources`` per group, in the order of importance
    (descending) and id.  A group is named by the id of its first member.
    """
    rows = eligible(df, include_archived).withColumns({
        "memory_type": F.coalesce("memory_type", F.lit("unknown")),
        "domain": F.coalesce("domain", F.lit("general"))})
    slim = rows.select(F.to_json(F.struct(*BUCKET)).alias("bucket"), "id",
                       (-F.coalesce("importance", F.lit(0.0))).alias("neg_importance"),
                       content_tokens(F.coalesce("content", F.lit(""))).alias("words"))
    placed = materialize(with_position(slim, ["bucket"], ["neg_importance", "id"]), "group-order")
    heads = token_groups(placed, config.max_sources, config.window_rows)
    sizes = heads.groupBy("bucket", "head").agg(F.count("*").alias("n_members")).where(
        F.col("n_members") >= config.min_sources)
    first = placed.select("bucket", F.col("position").alias("head"), F.col("id").alias("group_id"))
    grouped = heads.join(sizes.join(first, ["bucket", "head"]), ["bucket", "head"]).join(
        placed.select("bucket", "position", "id"), ["bucket", "position"]).select("id", "group_id", "n_members")
    return rows.join(grouped, "id")


# -- per-group results -------------------------------------------------------------

def _placed(groups: DataFrame) -> DataFrame:
    return numbered(groups, ["group_id"], [F.desc("importance"), F.asc("id")], "position")


def infer_topic(groups: DataFrame) -> DataFrame:
    """``group_id, topic``: most voted pattern topic, else a common word, else type and domain."""
    rows = _placed(groups).withColumn("words", content_tokens(F.coalesce("content", F.lit(""))))
    flags = F.array(*[F.when(matches(F.col("content"), p, True), F.struct(
        F.lit(i).alias("rule"), F.lit(t).alias("name"))) for i, (t, p) in enumerate(lx.GROUP_TOPICS)])
    votes = rows.select("group_id", "position", F.explode(F.array_compact(flags)).alias("v"))
    voted = votes.groupBy("group_id", "v.name").agg(
        F.count("*").alias("n"), F.min(F.struct("position", "v.rule")).alias("seen"))
    topic = top_k(voted, ["group_id"], [F.desc("n"), F.asc("seen")], 1, rank="__rn").select(
        "group_id", F.col("name").alias("voted"))
    words = rows.select("group_id", "position", F.posexplode("words").alias("spot", "word"))
    common = words.groupBy("group_id", "word").agg(
        F.count("*").alias("n"), F.min(F.struct("position", "spot")).alias("seen"))
    common = top_k(common, ["group_id"], [F.desc("n"), F.asc("seen")], 1, rank="__rn").select(
        "group_id", "word", "n")
    base = rows.groupBy("group_id").agg(
        F.count("*").alias("size"), F.min_by(F.struct("memory_type", "domain"), "position").alias("f"))
    fallback = F.when(F.col("f.domain") != "general", F.concat_ws("/", "f.memory_type", "f.domain")).otherwise(
        F.col("f.memory_type"))
    enough = F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("size") / 2))
    return base.join(topic, "group_id", "left").join(common, "group_id", "left").select(
        "group_id", F.coalesce("voted", F.when(enough, F.col("word")), fallback).alias("topic"))


def group_conflicts(groups: DataFrame, config: ConsolidationConfig = DEFAULTS) -> DataFrame:
    """Conflicting pairs inside groups: ``group_id, id_a, id_b, similarity, severity, reason``.

    At most 190 pairs per group.
    """
    norm = normalize_text(F.coalesce("content", F.lit("")))
    rows = _placed(groups).select("group_id", "position", "id", norm.alias("norm"))
    rows = rows.withColumn("tokens", F.array_distinct(tokenize(F.col("norm"))))
    sets = rows.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", "id", "norm", "tokens"))).alias("ms"))
    pairs = F.flatten(F.transform("ms", lambda x, i: F.transform(
        F.slice("ms", i + 2, F.size("ms")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    flat = sets.select("group_id", F.explode(pairs).alias("p")).select(
        "group_id", F.col("p.a.id").alias("id_a"), F.col("p.b.id").alias("id_b"),
        F.col("p.a.norm").alias("an"), F.col("p.b.norm").alias("bn"),
        F.col("p.a.tokens").alias("at"), F.col("p.b.tokens").alias("bt"))
    # the token share is the similarity of all pairs but those of very short texts; it settles most
    # pairs before the rest goes through Python
    short = (F.size("at") < 3) | (F.size("bt") < 3)
    share = jaccard(F.col("at"), F.col("bt"))
    near = (share >= config.conflict_similarity_low - 0.01) & (share < config.conflict_similarity_high + 0.01)
    scored = with_similarity(flat.where(short | near), "an", "bn", "at", "bt").where(
        (F.col("similarity") < config.conflict_similarity_high)
        & (F.col("similarity") >= config.conflict_similarity_low))
    sim = F.col("similarity")
    shown = F.concat(F.lit(" (similarity "), F.format_string("%.2f", sim), F.lit(")"))
    return scored.select(
        "group_id", "id_a", "id_b", "similarity",
        F.when(sim >= 0.60, "low").when(sim >= 0.40, "medium").otherwise("high").alias("severity"),
        F.concat(F.when(sim >= 0.60, "Slight phrasing difference").when(
            sim >= 0.40, "Factual disagreement detected").otherwise("Direct contradiction suspected"),
            shown).alias("reason"))


def group_severity(conflicts: DataFrame) -> DataFrame:
    """Worst severity and number of conflicts per group."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    worst = F.max(rank)
    return conflicts.groupBy("group_id").agg(
        F.count("*").alias("n_conflicts"),
        F.when(worst == 3, "high").when(worst == 2, "medium").otherwise("low").alias("severity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("id_a", "id_b"))))).alias("conflicting_ids"),
        F.sort_array(F.collect_list(F.struct("id_a", "id_b", "similarity", "severity", "reason"))).alias("records"))


def source_score(as_of) -> Column:
    conf = F.coalesce("confidence", F.lit(0.5))
    imp = F.coalesce("importance", F.lit(0.5))
    share = F.least(F.lit(1.0), F.coalesce(F.unix_millis("created_at"), F.lit(0)) / F.unix_millis(as_timestamp(as_of)))
    return (conf * imp) * 0.7 + share * 0.3


def elect_source(groups: DataFrame, as_of) -> DataFrame:
    """``group_id, id, source_score``: the member a group trusts most, first on ties."""
    rows = _placed(groups).withColumn("source_score", source_score(as_of))
    return top_k(rows, ["group_id"], [F.desc("source_score"), F.asc("position")], 1, rank="__rn").select(
        "group_id", "id", "source_score")


def short_summary(topic: Column, n: Column) -> Column:
    """At most 200 characters from ``best_content`` / ``best_summary``."""
    content = F.coalesce("best_content", "best_summary", F.lit(""))
    source = F.when((F.length(content) > 200) & (F.length("best_summary") > 0), F.col("best_summary")).otherwise(content)
    cut = F.when(F.length(source) > 200, F.concat(F.substring(source, 1, 197), F.lit("…"))).otherwise(source)
    return F.when(F.length(cut) > 0, cut).otherwise(F.concat(
        F.lit("Consolidated "), topic, F.lit(" knowledge from "), n.cast("string"), F.lit(" sources")))


def consolidate(groups: DataFrame, as_of, config: ConsolidationConfig = DEFAULTS, *,
                summarise=None) -> DataFrame:
    """One consolidated memory per group.

    ``summarise`` replaces the default summary: a ``pandas_udf`` over the array
    of member texts and the topic.
    """
    rows = _placed(groups).withColumn("source_score", source_score(as_of))
    conf, imp = F.coalesce("confidence", F.lit(0.5)), F.coalesce("importance", F.lit(0.5))
    tags = F.array_distinct(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("position", "tags"))), lambda e: e["tags"])))
    inactive = F.coalesce("lifecycle_state", F.lit("active")).isin("stale", "archived")
    per_group = rows.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("user_id", "memory_type", "domain"), "position").alias("f"),
        F.max_by(F.struct("id", "content", "summary"), F.struct("source_score", -F.col("position"))).alias("best"),
        F.array_sort(F.collect_list("id")).alias("source_ids"),
        F.sum(conf * imp).alias("ci"), F.sum(imp).alias("i"), F.avg(conf).alias("avg_conf"),
        F.avg(imp).alias("avg_imp"), tags.alias("tags"), F.count_if(inactive).alias("n_inactive"),
        F.sort_array(F.collect_list(F.struct("position", "content"))).alias("texts"))
    joined = (per_group.join(infer_topic(groups), "group_id")
              .join(group_severity(group_conflicts(groups, config)), "group_id", "left"))
    joined = joined.withColumns({"best_content": F.col("best.content"), "best_summary": F.col("best.summary")})
    if summarise is None:
        joined = joined.withColumn("summary", short_summary(F.col("topic"), F.col("n")))
    else:
        joined = joined.withColumn("summary", summarise(
            F.transform("texts", lambda t: t["content"]), F.col("topic")))
    joined = with_rounded(
        joined,
        confidence=F.when(F.col("i") > 0, F.col("ci") / F.col("i")).otherwise(F.col("avg_conf")),
        importance=F.least(F.lit(0.95), F.col("avg_imp") * 1.1),
        avg_confidence=F.col("avg_conf"), avg_importance=F.col("avg_imp"))
    clash = F.col("n_conflicts").isNotNull()
    status = (F.when(clash, "conflicted")
              .when(F.col("n_inactive") / F.col("n") >= config.stale_fraction, "stale").otherwise("active"))
    user = F.coalesce(F.col("f.user_id"), F.lit("unknown"))
    raw_id = F.concat(F.lit("con_"), user, F.lit("_"), F.col("topic"), F.lit("_"),
                      F.array_join(F.slice("source_ids", 1, 2), "-"))
    meta = F.when(clash, F.struct(
        F.col("records").alias("conflicts"), "conflicting_ids", "severity",
        F.col("best.id").alias("resolved_with"), as_timestamp(as_of).alias("detected_at"),
        F.concat(F.col("n_conflicts").cast("string"), F.lit(" conflict(s) detected among "),
                 F.col("n").cast("string"), F.lit(" source memories")).alias("reason")))
    return joined.select(
        "group_id", F.regexp_replace(raw_id, "[^a-zA-Z0-9_-]", "_").alias("id"),
        F.col("f.user_id").alias("user_id"), "topic", "summary", "source_ids", "confidence", "importance",
        as_timestamp(as_of).alias("created_at"), as_timestamp(as_of).alias("updated_at"),
        F.lit(1).alias("version"), status.alias("status"), meta.alias("conflict_meta"),
        F.col("f.memory_type").alias("memory_type"),
        F.array_union("tags", F.array(F.lit("consolidated"))).alias("tags"), F.col("f.domain").alias("domain"),
        (F.col("n") > F.col("n_inactive")).alias("has_active"))


def needs_reconsolidation(existing: DataFrame, built: DataFrame,
                          config: ConsolidationConfig = DEFAULTS) -> DataFrame:
    """``existing_id, group_id, needed`` for groups whose smallest source id is already consolidated.

    Needed when enough of the sources are new, or when the stored fact is stale
    and the group has an active source.
    """
    old = existing.select(F.col("id").alias("existing_id"), "user_id", F.col("status").alias("old_status"),
                          F.col("source_ids").alias("old_ids"), F.array_min("source_ids").alias("first_id"),
                          F.col("updated_at").alias("old_updated"))
    # several facts with the same first source: the last one stored counts
    old = top_k(old.where(F.col("first_id").isNotNull()), ["user_id", "first_id"],
                [F.desc("old_updated"), F.asc("existing_id")], 1, rank="__rn").drop("__rn", "old_updated")
    new = built.select("group_id", "user_id", "source_ids", "has_active", F.array_min("source_ids").alias("first_id"))
    both = new.join(old, ["user_id", "first_id"])
    fresh = F.size(F.array_except("source_ids", "old_ids")) / F.size("source_ids")
    needed = (fresh >= config.reconsolidate_fraction) | ((F.col("old_status") == "stale") & F.col("has_active"))
    return both.select("existing_id", "group_id", "user_id", fresh.alias("new_fraction"), needed.alias("needed"))


def update_consolidated(existing: DataFrame, built: DataFrame, matched: DataFrame, as_of) -> DataFrame:
    """Next version of stored facts: ids united, everything else recomputed, version + 1."""
    old = existing.select(F.col("id").alias("existing_id"), F.col("source_ids").alias("old_ids"),
                          F.col("created_at").alias("old_created"), F.col("version").alias("old_version"),
                          F.col("topic").alias("old_topic"), F.col("memory_type").alias("old_type"))
    rows = matched.where("needed").select("existing_id", "group_id").join(old, "existing_id").join(
        built.drop("has_active"), "group_id")
    return rows.select(
        "group_id", F.col("existing_id").alias("id"), "user_id", F.col("old_topic").alias("topic"), "summary",
        F.array_sort(F.array_union("old_ids", "source_ids")).alias("source_ids"), "confidence", "importance",
        F.col("old_created").alias("created_at"), as_timestamp(as_of).alias("updated_at"),
        (F.coalesce("old_version", F.lit(1)) + 1).alias("version"), "status", "conflict_meta",
        F.col("old_type").alias("memory_type"), "tags", "domain")


def sweep_actions(existing: DataFrame, built: DataFrame, config: ConsolidationConfig = DEFAULTS) -> DataFrame:
    """What a sweep does with each group: ``group_id, user_id, action, existing_id``."""
    matched = needs_reconsolidation(existing, built, config)
    joined = built.select("group_id", "user_id").join(matched.drop("user_id"), "group_id", "left")
    action = (F.when(F.col("existing_id").isNull(), "created").when(F.col("needed"), "updated")
              .otherwise("skipped"))
    return joined.select("group_id", "user_id", action.alias("action"), "existing_id")


def consolidation_sweep(memories: DataFrame, existing: DataFrame, as_of,
                        config: ConsolidationConfig = DEFAULTS, *, groups: DataFrame | None = None,
                        summarise=None) -> tuple[DataFrame, DataFrame]:
    """(rows to upsert, per-user counts of created, updated and skipped)."""
    members = group_candidates(memories, config) if groups is None else groups
    built = materialize(consolidate(members, as_of, config, summarise=summarise), "built")
    matched = needs_reconsolidation(existing, built, config)
    actions = sweep_actions(existing, built, config)
    created = built.join(actions.where("action = 'created'").select("group_id"), "group_id", "left_semi")
    changed = update_consolidated(existing, built, matched, as_of)
    columns = [c for c in built.columns if c not in ("has_active", "group_id")]
    upserts = created.select(*columns).unionByName(changed.select(*columns))
    counts = actions.groupBy("user_id").agg(
        *[F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "skipped")],
        F.count("*").alias("groups"))
    return upserts, counts


# -- provenance -----------------------------------------------------------------------

def provenance(consolidated: DataFrame, memories: DataFrame) -> DataFrame:
    """Source count and latest source of each consolidated memory."""
    sources = consolidated.select("id", F.posexplode("source_ids").alias("spot", "source_id"))
    found = sources.join(memories.select(F.col("id").alias("source_id"), "created_at"), "source_id")
    latest = found.where(F.col("created_at").isNotNull()).groupBy("id").agg(F.max_by(
        F.struct("source_id", "created_at"), F.struct("created_at", -F.col("spot"))).alias("l"))
    return consolidated.join(latest, "id", "left").select(
        "id", F.size("source_ids").alias("source_count"), F.col("l.source_id").alias("latest_source_id"),
        F.col("l.created_at").alias("latest_source_at"), "confidence", "conflict_meta", "version")


def with_evidence(consolidated: DataFrame, memories: DataFrame) -> DataFrame:
    """Consolidated memories with their (at most a few dozen) source rows attached."""
    sources = consolidated.select("id", F.posexplode("source_ids").alias("spot", "source_id"))
    rows = memories.select(F.col("id").alias("source_id"), F.struct(
        "id", "content", "memory_type", "importance", "confidence", "created_at").alias("row"))
    lists = sources.join(rows, "source_id").groupBy("id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("spot", "row"))), lambda e: e["row"]).alias("sources"))
    return consolidated.join(lists, "id", "left")
