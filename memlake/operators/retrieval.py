"""Scoring, ranking and top-k retrieval for a table of queries.

A queries table has ``query_id, session_id, user_id, query_text, query_at`` and,
for vector search, ``embedding``.  Memory tables have ``id, session_id,
user_id, content, summary, importance, created_at, access_count, fingerprint``
and, for vector search, ``embedding``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.config import HybridWeights, LifecycleConfig, RetrievalConfig
from memlake.functions import scoring as sc
from memlake.functions.lexicon import STORE_SMALL_TALK_WORDS
from memlake.functions.text import (
    as_timestamp, hours_between, keyword_score, query_overlap, tokenize,
)
from memlake.operators.dedup import merge_by_id
from memlake.operators.vector_search import shared_answers
from memlake.operators.windows import numbered, top_k
from memlake.session import materialize

DEFAULTS = RetrievalConfig()


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# -- signals -------------------------------------------------------------------

def recency_decay(created: Column, as_of, half_life_hours: float = 72.0) -> Column:
    """Halves every half-life, floor at ten; missing or future times count as fresh."""
    age = hours_between(created, as_timestamp(as_of))
    faded = F.exp(F.lit(-math.log(2) / half_life_hours) * F.least(age, F.lit(half_life_hours * 10)))
    return F.when(age.isNull() | (age <= 0), 1.0).otherwise(faded)


def access_bonus(count: Column) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n > 0, F.least(F.lit(0.15), F.log1p(n) / F.lit(math.log1p(100)))).otherwise(0.0)


def topical_penalty(score: Column, vector: Column, lexical: Column,
                    config: RetrievalConfig = DEFAULTS) -> Column:
    """Scale down rows related to the query neither by vector nor by words."""
    p = config.penalty
    if not p.enabled:
        return score
    relevance = F.greatest(F.coalesce(vector, F.lit(0.0)), F.coalesce(lexical, F.lit(0.0)))
    factor = (F.when(relevance < p.low_threshold, p.low_penalty)
              .when(relevance < p.high_threshold, p.medium_penalty).otherwise(1.0))
    return score * factor


def hybrid_score(df: DataFrame, as_of, config: RetrievalConfig = DEFAULTS) -> DataFrame:
    """Add ``vector_part, lexical_part, importance_part, recency_part, session_bonus, score``.

    Reads ``vector_score, lexical_score`` (a count of shared words),
    ``importance, created_at, session_id, query_session_id``.
    """
    df = df.withColumns({
        "vector_part": unit(F.coalesce("vector_score", F.lit(0.0))),
        "lexical_part": F.least(F.lit(1.0), F.coalesce("lexical_score", F.lit(0.0)) / F.lit(5.0)),
        "importance_part": unit(F.coalesce("importance", F.lit(0.0))),
        "recency_part": recency_decay(F.col("created_at"), as_of, config.recency_half_life_hours),
        "session_bonus": F.when(F.col("session_id").eqNullSafe(F.col("query_session_id")),
                                config.session_bonus).otherwise(0.0),
    })
    raw = (F.col("vector_part") * config.vector_weight + F.col("lexical_part") * config.lexical_weight
           + F.col("importance_part") * config.importance_weight
           + F.col("recency_part") * config.recency_weight + F.col("session_bonus"))
    df = df.withColumn("__raw", raw)
    scored = topical_penalty(F.col("__raw"), F.col("vector_part"), F.col("lexical_part"), config)
    df = df.withColumn("__score", scored)
    return df.withColumns({
        "score": F.least(F.lit(1.0), F.col("__score")),
        "penalized": F.col("__score") != F.col("__raw"),
    }).drop("__raw", "__score")


def _live_queries(queries: DataFrame) -> DataFrame:
    """Greetings retrieve nothing."""
    return queries.where(~sc.is_small_talk(F.col("query_text"), STORE_SMALL_TALK_WORDS))


def _shown_text() -> Column:
    return F.when(F.length("summary") > 0, F.col("summary")).otherwise(
        F.coalesce("content", F.lit("")))


# -- channels ---------------------------------------------------------------------

def vector_topk(queries: DataFrame, memories: DataFrame, as_of, k: int | None = None, *,
                scope: list[str] = ["user_id"],  # noqa: B006
                config: RetrievalConfig = DEFAULTS) -> DataFrame:
    """Best ``k`` memories per query by hybrid score among the ``3k`` nearest vectors.

    ``scope`` names the columns that must agree (user by default; session for
    the strict variant).
    """
    k = k or config.top_k
    asked = _live_queries(queries)
    asked_of, near = shared_answers(asked, memories, 3 * k, scope=scope)
    columns = ["id", "session_id", "user_id", "content", "summary", "memory_type", "importance",
               "created_at", "access_count", "fingerprint"]
    # a memory is hit by many queries: its words are found once, in front of the join, and it is
    # joined once for all queries with one vector
    shown = memories.select(*columns, tokenize(_shown_text()).alias("tokens"))
    found = near.select("asked_id", F.col("item_id").alias("id"), F.col("cosine").alias("vector_score")).join(shown, "id")
    hits = asked.select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("session_id").alias("query_session_id"),
        tokenize(F.col("query_text")).alias("query_tokens")).join(asked_of, "query_id").join(found, "asked_id")
    hits = hits.withColumn("lexical_score", query_overlap(F.col("query_tokens"), F.col("tokens"))).drop(
        "query_tokens", "tokens", "asked_id")
    # the score bound keeps a prefix of the ranking, so it may follow the cut; in front of it
    # the optimizer would push a second copy of the whole score below the projections
    best = top_k(hybrid_score(hits, as_of, config), ["query_id"], [F.desc("score"), F.asc("id")], k)
    return best.where(F.col("score") > config.min_score)


def keyword_topk(queries: DataFrame, memories: DataFrame, as_of, k: int | None = None, *,
                 config: RetrievalConfig = DEFAULTS) -> DataFrame:
    """Best ``k`` memories of the query's session by shared words and importance.

    Only the ``4k`` most important memories of a session are considered, so
    the join with the queries is bounded however large a session is.
    """
    k = k or config.top_k
    columns = ["id", "session_id", "user_id", "content", "summary", "memory_type", "importance",
               "created_at", "access_count", "fingerprint"]
    pool = top_k(memories.select(*columns), ["session_id"],
                 [F.desc("importance"), F.desc("created_at"), F.asc("id")], 4 * k, rank="__pool")
    pool = pool.drop("__pool").withColumn("tokens", tokenize(_shown_text()))
    asked = _live_queries(queries).select(
        F.col("query_id").cast("string").alias("query_id"), "session_id",
        F.col("session_id").alias("query_session_id"),
        tokenize(F.col("query_text")).alias("query_tokens"))
    hits = asked.join(pool, "session_id").withColumns({
        "vector_score": F.lit(0.0),
        "lexical_score": query_overlap(F.col("query_tokens"), F.col("tokens"))})
    hits = hits.where((F.col("lexical_score") > 0)
                      | (F.col("importance") >= config.min_importance_without_match))
    scored = hybrid_score(hits.drop("query_tokens", "tokens"), as_of, config)
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("id")], k)


def inverted_index(memories: DataFrame, scope: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    """Term postings ``(scope…, term, id, tf)`` of content and summary."""
    words = tokenize(F.concat_ws(" ", "content", "summary"))
    return (memories.select(*scope, "id", F.explode(words).alias("term"))
            .groupBy(*scope, "term", "id").agg(F.count("*").alias("tf")))


def fulltext_rank(queries: DataFrame, memories: DataFrame,
                  scope: list[str] = ["session_id"]) -> DataFrame:  # noqa: B006
    """tf-idf rank of memories per query: ``query_id, id, rank_score``.

    Stands in for the database's cover-density rank, which it does not equal.
    """
    postings = inverted_index(memories, scope)
    sizes = memories.groupBy(*scope).agg(F.count("*").alias("n_docs"))
    spread = postings.groupBy(*scope, "term").agg(F.count("*").alias("df")).join(sizes, scope)
    terms = _live_queries(queries).select(
        "query_id", *scope, F.explode(F.array_distinct(tokenize(F.col("query_text")))).alias("term"))
    weighted = terms.join(spread, [*scope, "term"]).withColumn(
        "idf", F.log(F.lit(1.0) + F.col("n_docs") / F.col("df")))
    return (weighted.join(postings, [*scope, "term"])
            .groupBy("query_id", "id")
            .agg(F.sum(F.col("tf") * F.col("idf")).alias("rank_score")))


# -- reranking -------------------------------------------------------------------

def rerank(candidates: DataFrame, as_of, k: int | None = None, *,
           config: RetrievalConfig = DEFAULTS) -> DataFrame:
    """One row per fingerprint and query, hybrid-scored, best ``k``.

    ``arrival`` orders equal importances.
    """
    key = F.when(F.length("fingerprint") > 0, F.col("fingerprint")).otherwise(F.col("id"))
    single = top_k(candidates.withColumn("__key", key), ["query_id", "__key"],
                   [F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("arrival"), F.asc("id")],
                   1, rank="__rn").drop("__rn", "__key")
    scored = hybrid_score(single, as_of, config)
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("arrival"), F.asc("id")],
                 k or config.top_k)


def explain_reason(vector: Column, keyword: Column, importance: Column, recency: Column,
                   graph: Column, sources: Column) -> Column:
    """Readable reason of a ranked row."""
    parts = F.array_compact(F.array(
        F.when(vector >= 0.5, "strong vector similarity").when(vector > 0, "partial vector similarity"),
        F.when(keyword >= 0.4, "keyword match"),
        F.when(importance >= 0.7, "high importance").when(importance >= 0.4, "moderate importance"),
        F.when(recency >= 0.8, "recent"),
        F.when(graph >= 0.5, "graph-connected")))
    text = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("low-signal match")
    return F.concat(F.lit("Selected via "), F.array_join(sources, "+"), F.lit(" — "), text)


def rank_memories(candidates: DataFrame, as_of, k: int | None = None, *,
                  weights: HybridWeights = HybridWeights(), min_score: float = 0.0,
                  half_life_hours: float = 72.0) -> DataFrame:
    """Five-signal weighted rank with the reason spelled out.

    Reads ``query_id, id, vector_score, keyword_score, graph_score, importance,
    access_count, created_at, sources``.
    """
    w = weights.clamped()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = candidates.withColumns({
        "importance_score": unit(zero("importance")),
        "recency_score": recency_decay(F.col("created_at"), as_of, half_life_hours),
        "access_bonus": access_bonus(F.col("access_count")),
        "vector_score": zero("vector_score"), "keyword_score": zero("keyword_score"),
        "graph_score": zero("graph_score")})
    df = df.withColumn("blended_importance", F.least(
        F.lit(1.0), F.col("importance_score") + F.col("access_bonus")))
    df = df.withColumn("final_score", F.least(F.lit(1.0), (
        F.col("vector_score") * w.vector + F.col("keyword_score") * w.keyword
        + F.col("blended_importance") * w.importance + F.col("recency_score") * w.recency
        + F.col("graph_score") * w.graph)))
    df = df.withColumn("reason", explain_reason(
        F.col("vector_score"), F.col("keyword_score"), F.col("blended_importance"),
        F.col("recency_score"), F.col("graph_score"), F.col("sources")))
    best = top_k(df, ["query_id"], [F.desc("final_score"), F.asc("id")], k or DEFAULTS.top_k)
    return best.where(F.col("final_score") > min_score)


def graph_enrich(candidates: DataFrame, neighbours: DataFrame, context: DataFrame | None,
                 queries: DataFrame, k: int | None = None) -> DataFrame:
    """Graph score of the first ``2k`` candidates, and neighbours not yet present.

    ``candidates`` carry ``position`` (order per query); ``neighbours`` are the
    top similar memories per id: ``id, neighbour_id, importance, content,
    summary, created_at, access_count``; ``context`` has ``id, entity_count,
    rel_count``.
    """
    k = k or DEFAULTS.top_k
    limit = max(3, math.ceil(k / 2))
    near = top_k(neighbours, ["id"], [F.desc("importance"), F.asc("neighbour_id")], limit, rank="__n").drop("__n")
    counted = near.groupBy("id").agg(F.count("*").alias("n_similar"))
    head = F.col("position") <= 2 * k
    df = candidates.join(counted, "id", "left")
    if context is not None:
        df = df.join(context.select("id", "entity_count", "rel_count"), "id", "left")
    else:
        df = df.withColumns({"entity_count": F.lit(0), "rel_count": F.lit(0)})
    similar = F.coalesce("n_similar", F.lit(0))
    entities, rels = F.coalesce("entity_count", F.lit(0)), F.coalesce("rel_count", F.lit(0))
    by_similar = F.when(similar > 0, F.lit(0.3) + (similar / F.lit(5.0)) * 0.5).otherwise(0.0)
    by_context = F.when((entities > 0) | (rels > 0),
                        F.lit(0.25) + F.least(F.lit(0.3), (entities / F.lit(10.0)) * 0.3)
                        + F.least(F.lit(0.15), (rels / F.lit(10.0)) * 0.15)).otherwise(0.0)
    scored = df.withColumn("graph_score", F.when(
        head, F.least(F.lit(1.0), F.greatest(by_similar, by_context))).otherwise(0.0))
    scored = scored.drop("n_similar", "entity_count", "rel_count")

    reached = (candidates.where(head).select("query_id", "id", "position").join(near, "id")
               .drop("id").withColumnRenamed("neighbour_id", "id"))
    fresh = reached.join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
    fresh = top_k(fresh, ["query_id", "id"], [F.asc("position")], 1, rank="__first").drop("__first", "position")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"),
                           tokenize(F.col("query_text")).alias("query_tokens"))
    extra = fresh.join(asked, "query_id").withColumn("tokens", tokenize(_shown_text())).withColumns({
        "vector_score": F.lit(0.0),
        "keyword_score": keyword_score(F.col("query_tokens"), F.col("tokens")),
        "graph_score": F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.0)) * 0.4 + 0.6),
        "sources": F.array(F.lit("graph"))}).drop("query_tokens", "tokens")
    return scored.drop("position").unionByName(extra, allowMissingColumns=True)


def hybrid_retrieve(queries: DataFrame, memories: DataFrame, neighbours: DataFrame,
                    context: DataFrame | None, as_of, k: int | None = None, *,
                    weights: HybridWeights = HybridWeights(), scope: list[str] = ["user_id"],  # noqa: B006
                    config: RetrievalConfig = DEFAULTS, legacy_double_norm: bool = False,
                    channels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Vector and keyword channels, merged per memory, graph-enriched and ranked.

    ``legacy_double_norm`` divides the already scaled word overlap by five once
    more.  ``channels`` are the results of :func:`vector_topk` and :func:`keyword_topk`
    with the same arguments, where a caller has them already.
    """
    k = k or config.top_k
    base = ["query_id", "id", "content", "summary", "importance", "created_at", "access_count",
            "fingerprint", "session_id", "user_id", "memory_type"]
    scale = F.lit(5.0 if legacy_double_norm else 1.0)
    near, facts = channels or (vector_topk(queries, memories, as_of, k, scope=scope, config=config),
                               keyword_topk(queries, memories, as_of, k, config=config))
    parts = [
        near.select(
            *base, F.col("vector_part").alias("vector_score"),
            (F.col("lexical_part") / scale).alias("keyword_score"), F.lit(0.0).alias("graph_score"),
            F.lit("vector").alias("source"), F.struct(F.lit(0).alias("c"), F.col("rank")).alias("channel")),
        facts.select(
            *base, F.lit(0.0).alias("vector_score"),
            (F.col("lexical_part") / scale).alias("keyword_score"), F.lit(0.0).alias("graph_score"),
            F.lit("keyword").alias("source"), F.struct(F.lit(1).alias("c"), F.col("rank")).alias("channel")),
    ]
    both = materialize(parts[0].unionByName(parts[1]), "hybrid-channels")
    seen = both.groupBy("query_id", "id").agg(F.min("channel").alias("seen"))
    merged = merge_by_id(both).join(seen, ["query_id", "id"])
    # written once: graph scores, new neighbours and what is already there all read these few rows a query
    placed = materialize(numbered(merged, ["query_id"], [F.asc("seen"), F.asc("id")], "position").drop("seen"), "hybrid-candidates")
    enriched = graph_enrich(placed, neighbours, context, queries, k)
    return rank_memories(enriched, as_of, k, weights=weights,
                         half_life_hours=config.recency_half_life_hours)


def lifecycle_rerank(ranked: DataFrame, include_archived: bool = False, k: int | None = None, *,
                     config: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """Drop archived rows, scale stale and conflicted ones, sort again and cut.

    Reads ``query_id, id, final_score, lifecycle_state, reason``.
    """
    state = F.coalesce("lifecycle_state", F.lit("active"))
    visible = ranked if include_archived else ranked.where(state != "archived")
    factor = (F.when(state == "stale", config.stale_penalty)
              .when(state == "conflicted", config.conflict_penalty)
              .when(state == "archived", 0.1).otherwise(1.0))
    note = (F.when(state == "stale", f"stale penalty ×{config.stale_penalty:g}")
            .when(state == "conflicted", f"conflict penalty ×{config.conflict_penalty:g}")
            .when(state == "archived", "archived — heavy penalty"))
    order = [F.desc("final_score"), F.asc("id")]
    scored = visible.withColumns({
        "penalty": factor, "final_score": unit(F.col("final_score") * factor),
        "reason": F.when(note.isNull(), F.col("reason")).otherwise(
            F.concat("reason", F.lit(" [lifecycle: "), note, F.lit("]")))}).drop("rank")
    return top_k(scored, ["query_id"], order, k)


def rank_consolidations(consolidated: DataFrame, k: int = 3, *, include_superseded: bool = False,
                        config: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """Best ``k`` consolidated memories per user, scaled by status."""
    status = F.col("status")
    rows = consolidated if include_superseded else consolidated.where(status != "superseded")
    factor = (F.when(status == "stale", config.stale_penalty)
              .when(status == "conflicted", config.conflict_penalty)
              .when(status == "superseded", 0.05).otherwise(1.0))
    scored = rows.withColumn("score", unit(F.col("confidence") * F.col("importance") * factor))
    return top_k(scored, ["user_id"], [F.desc("score"), F.desc("importance"), F.asc("id")], k,
                 rank="consolidation_rank")


def inject_consolidations(ranked: DataFrame, consolidated: DataFrame, queries: DataFrame, k: int = 3, *,
                          config: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """Place each user's best consolidated memories behind the first ranked memory.

    Returns ``query_id, position, id, kind``; ``ranked`` has ``query_id, id, rank``.
    """
    best = rank_consolidations(consolidated, k, config=config).select(
        "user_id", F.col("id").alias("cid"), "consolidation_rank")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "user_id")
    extra = asked.join(best, "user_id").select(
        "query_id", F.col("cid").alias("id"), F.lit("consolidation").alias("kind"),
        F.lit(1.5).alias("spot"), F.col("consolidation_rank").alias("tie"))
    rows = ranked.select("query_id", "id", F.lit("memory").alias("kind"),
                         F.col("rank").cast("double").alias("spot"), F.lit(0).alias("tie"))
    return numbered(rows.unionByName(extra), ["query_id"], [F.asc("spot"), F.asc("tie")],
                    "position").drop("spot", "tie")


def seed_memories(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """Memories of the query's own event sharing a longer word with its text.

    ``queries`` carry ``event_id``; ``seeds`` are memories extracted from the
    same events.
    """
    words = F.filter(F.split(F.lower("query_text"), r"\s+"), lambda w: F.length(w) > 3)
    asked = queries.where(~sc.is_small_talk(F.col("query_text"))).select(
        F.col("query_id").cast("string").alias("query_id"), "event_id",
        F.col("session_id").alias("query_session_id"), words.alias("words"))
    shown = F.lower(_shown_text())
    own = asked.join(seeds.withColumn("shown", shown), "event_id")
    return own.where(F.exists("words", lambda w: F.contains(F.col("shown"), w))).drop("words", "shown")


def working_set(queries: DataFrame, channels: list[DataFrame], as_of, k: int | None = None, *,
                config: RetrievalConfig = DEFAULTS) -> DataFrame:
    """Union of the channels in order, reranked; greetings get an empty set.

    Each channel has ``query_id, query_session_id, id, session_id, fingerprint,
    importance, created_at, vector_score, lexical_score``.
    """
    columns = ["query_id", "query_session_id", "id", "session_id", "fingerprint", "importance",
               "created_at", "vector_score", "lexical_score"]
    rows = None
    for i, channel in enumerate(channels):
        part = channel.select(*columns, F.lit(i).alias("arrival"))
        rows = part if rows is None else rows.unionByName(part)
    # store scores of a memory apply to every copy of it, the last channel wins;
    # channels without store scores leave them null
    scores = rows.where(F.col("vector_score").isNotNull()).groupBy(
        "query_id", "id").agg(F.max_by(F.struct("vector_score", "lexical_score"), "arrival").alias("s"))
    live = queries.where(~sc.is_small_talk(F.col("query_text"))).select(
        F.col("query_id").cast("string").alias("query_id"))
    rows = (rows.drop("vector_score", "lexical_score").join(live, "query_id", "left_semi")
            .join(scores, ["query_id", "id"], "left").select(
                "*", F.col("s.vector_score").alias("vector_score"),
                F.col("s.lexical_score").alias("lexical_score")).drop("s"))
    return rerank(rows, as_of, k, config=config)


def _carry(k: int):
    """Sets of a session's turns one after another; only the set of the turn before is kept."""
    columns = ["query_id", "id", "rank", "score", "arrival"]

    def settle(held: list[tuple], turn: list[tuple]) -> list[tuple]:
        """Rows of (key, importance, arrival, id, score): the turn's own and those carried, best first."""
        scored = {r[3]: r[4] for r in turn if r[5]}
        rows = [(key, importance, 1, id_, scored.get(id_, score)) for key, importance, _, id_, score in held]
        single: dict = {}
        for r in [*rows, *(r[:5] for r in turn)]:
            best = single.get(r[0])
            if best is None or (-r[1], r[2], r[3]) < (-best[1], best[2], best[3]):
                single[r[0]] = r
        return sorted(single.values(), key=lambda r: (-r[4], r[2], r[3]))[:k]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, query, small, held, turn, out = None, None, False, [], [], []

        def close() -> list[tuple]:
            kept = [] if small else settle(held, turn)
            out.extend((query, r[3], i, r[4], r[2]) for i, r in enumerate(kept, 1))
            return kept

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.query_id != query:
                    if query is not None:
                        held = close()
                    if r.session_id != session:
                        held = []
                    session, query, small, turn = r.session_id, r.query_id, r.small_talk, []
                if r.id is not None:
                    turn.append((r.key, r.importance, r.arrival, r.id, r.score, r.scored))
            if out:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        if query is not None:
            close()
            yield pd.DataFrame(out, columns=columns)
    return run


def carried_working_sets(queries: DataFrame, channels: dict[int, DataFrame], as_of, k: int | None = None, *,
                         config: RetrievalConfig = DEFAULTS) -> DataFrame:
    """``query_id, rank, id, score, arrival``: the working set of every turn, with what the turn before left.

    ``channels`` by arrival (0 seeds, 2 facts, 3 vectors, 4 hybrid; 1 is the
    previous set) have the columns of :func:`working_set`; ``queries`` also
    ``query_at``.  A memory keeps its scores from turn to turn until a channel scores it
    again; of rows with one fingerprint the most important, then earliest channel's stays;
    a greeting gets and leaves an empty set.  A session's turns pass through one
    task in order, which holds the rows of one turn.
    """
    k = k or config.top_k
    columns = ["query_id", "query_session_id", "id", "session_id", "fingerprint", "importance",
               "created_at", "vector_score", "lexical_score"]
    rows = None
    for arrival, channel in channels.items():
        part = channel.select(*columns, F.lit(arrival).alias("arrival"))
        rows = part if rows is None else rows.unionByName(part)
    scores = rows.where(F.col("vector_score").isNotNull()).groupBy(
        "query_id", "id").agg(F.max_by(F.struct("vector_score", "lexical_score"), "arrival").alias("s"))
    rows = rows.drop("vector_score", "lexical_score").join(scores, ["query_id", "id"], "left").select(
        "*", F.col("s.vector_score").alias("vector_score"), F.col("s.lexical_score").alias("lexical_score"),
        F.col("s").isNotNull().alias("scored")).drop("s")
    key = F.when(F.length("fingerprint") > 0, F.col("fingerprint")).otherwise(F.col("id"))
    scored = hybrid_score(rows, as_of, config).select(
        "query_id", "id", key.alias("key"), F.coalesce("importance", F.lit(0.0)).alias("importance"), "arrival", "score", "scored")
    turns = queries.select(F.col("query_id").cast("string").alias("query_id"), "session_id", "query_at",
                           F.coalesce(sc.is_small_talk(F.col("query_text")), F.lit(False)).alias("small_talk"))
    return turns.join(scored, "query_id", "left").repartition("session_id").sortWithinPartitions(
        "session_id", "query_at", "query_id").select(
        "session_id", "query_id", "small_talk", "id", "key", "importance", "arrival", "score", "scored").mapInPandas(
        _carry(k), "query_id string, id string, rank int, score double, arrival int")


# -- working-set lifetime ------------------------------------------------------------

def memory_score() -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return unit(zero("importance") * 0.34 + zero("confidence") * 0.18 + zero("signal_strength") * 0.16
                + zero("permanence") * 0.12 + zero("specificity") * 0.08
                + zero("actionability") * 0.08 + zero("domain_confidence") * 0.04)


def working_set_ttl(members: DataFrame, turns: DataFrame, as_of, *, base: int = 7200,
                    shortest: int = 3600, longest: int = 604800) -> DataFrame:
    """Seconds each session's working set stays valid.

    ``members`` are the memories of the sets; ``turns`` has ``session_id,
    turn_count``.
    """
    per_set = members.groupBy("session_id").agg(
        F.max(memory_score()).alias("top"), F.avg(memory_score()).alias("mean"),
        F.max("created_at").alias("newest"), F.count("*").alias("memory_count"))
    df = per_set.join(turns, "session_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fresh = F.when(F.col("newest").isNull(), 0.25).otherwise(
        unit(F.lit(1.0) - hours_between(F.col("newest"), as_timestamp(as_of)) / 24))
    context = unit(F.coalesce("turn_count", F.lit(0)) / F.lit(8.0))
    relevance = unit(zero("top") * 0.45 + zero("mean") * 0.25 + fresh * 0.2 + context * 0.1)
    df = df.withColumn("relevance", relevance)
    start = min(max(base, shortest), longest)
    seconds = F.lit(float(start)) + F.lit(float(longest - start)) * F.col("relevance")
    clamped = F.greatest(F.lit(float(shortest)), F.least(F.lit(float(longest)), seconds))
    empty = (F.coalesce("memory_count", F.lit(0)) == 0) & (F.coalesce("turn_count", F.lit(0)) == 0)
    ttl = F.when(empty, F.lit(float(min(shortest, start)))).otherwise(F.floor(clamped + 0.5))
    return df.select("session_id", F.coalesce("memory_count", F.lit(0)).alias("memory_count"),
                     F.coalesce("turn_count", F.lit(0)).alias("turn_count"), "newest", "relevance",
                     ttl.cast("bigint").alias("ttl_seconds"))


def unexpired(sets: DataFrame, as_of, written: str = "newest") -> DataFrame:
    """Working sets still valid at ``as_of``."""
    age = hours_between(F.col(written), as_timestamp(as_of)) * 3600
    return sets.where(age < F.col("ttl_seconds"))
