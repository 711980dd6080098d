"""Events to memory rows: segmentation, classification, scores and the storage gate.

Each stage takes a DataFrame and adds columns.  All of them are row-local
native expressions, so a whole extraction is one narrow job; only the
within-event merge (``dedup.dedup_within_event``) shuffles, by event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import lexicon as lx
from memlake.functions import scoring as sc
from memlake.functions.text import (
    as_timestamp, count_matching, fingerprint, round2, summarize_140, tokenize, trim_space,
    with_rounded,
)
from memlake.operators.ordered import with_running

SCHEMA_VERSION = 3
GENERATED_BY = "heuristic-metadata-v3"
EXTRACTION_METHOD = "enhanced-pattern-scoring-analysis"


def segment_events(events: DataFrame) -> DataFrame:
    """One row per sentence or line; ``content`` becomes the segment text."""
    whole = trim_space(F.col("content"))
    pieces = F.split(whole, lx.expand_white_space(r"(?<=[.!?])\s+|\n+"))
    pieces = F.filter(F.transform(pieces, trim_space), lambda s: s != "")
    keep = [c for c in events.columns if c != "content"]
    return (events.where(whole != "")
            .select(*keep, pieces.alias("__pieces"))
            .select(*keep, F.posexplode("__pieces").alias("segment_index", "content")))


def with_tokens(df: DataFrame) -> DataFrame:
    """Lower-cased text and token list, shared by the stages below."""
    return df.withColumns({"lower": F.lower("content"), "tokens": tokenize(F.col("content"))})


def classify_type(df: DataFrame) -> DataFrame:
    """Pattern counts per type and the winning ``memory_type``."""
    df = df.withColumns(sc.type_counts(F.col("lower")))
    return df.withColumn("memory_type", sc.memory_type(F.col("n_factual"), F.col("n_episodic")))


def classify_with_confidence(df: DataFrame) -> DataFrame:
    """:func:`classify_type` plus confidence and up to two alternatives."""
    df = classify_type(df)
    f, e, s = F.col("n_factual"), F.col("n_episodic"), F.col("n_semantic")
    kind = F.col("memory_type")
    others = F.greatest(F.lit(1), f + e + s - 1)
    best = F.when(kind == "factual", f).when(kind == "episodic", e).otherwise(s)
    df = df.withColumn("__others", others)
    df = with_rounded(df, classification_confidence=F.least(
        F.lit(1.0), best / F.col("__others") + 0.3))
    scored = F.array(*[
        F.struct((-n).alias("neg"), F.lit(i).alias("rank"), F.lit(name).alias("type"))
        for i, (name, n) in enumerate([("factual", f), ("episodic", e), ("semantic", s)])])
    rest = F.sort_array(F.filter(scored, lambda x: (x["neg"] < 0) & (x["type"] != kind)))
    return df.withColumn("alternatives", F.transform(
        F.slice(rest, 1, 2), lambda x: F.struct(
            x["type"].alias("type"),
            round2(F.least(F.lit(1.0), -x["neg"] / F.col("__others") + 0.2)).alias("confidence")))
    ).drop("__others")


def infer_domain(df: DataFrame) -> DataFrame:
    """``domain``, ``domain_confidence`` and ``alternate_domains``."""
    df = df.withColumn("__domains", sc.scored_domains(F.col("lower")))
    cols = sc.domain_columns(F.col("lower"), F.col("__domains"))
    raw_confidence = cols.pop("domain_confidence")
    return with_rounded(df.withColumns(cols), domain_confidence=raw_confidence).drop("__domains")


def infer_tags(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", sc.tags(F.col("lower")))


def infer_keywords(df: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` best-scoring distinct terms of each row, best first."""
    df = df.withColumn("__terms", sc.sorted_terms(F.col("tokens")))
    df = df.withColumn("__starts", sc.term_starts(F.col("__terms")))
    ranked = sc.ranked_terms(F.col("__terms"), F.col("__starts"),
                             F.size("tokens").cast("double"))
    return df.withColumn("keywords", F.transform(
        F.slice(ranked, 1, k), lambda e: e["term"])).drop("__terms", "__starts")


def extract_entities(df: DataFrame) -> DataFrame:
    """Regex entities and proper names as an array of (type, value)."""
    df = df.withColumn("__entities", sc.entities(F.col("content")))
    return df.withColumn("entities", F.transform(
        F.col("__entities"), lambda v: F.struct(
            sc.entity_type(v).alias("type"), sc.entity_value(v).alias("value")))
    ).drop("__entities")


def score_rows(df: DataFrame, as_of) -> DataFrame:
    """All single-row scores; needs the columns of the stages above."""
    now = as_timestamp(as_of)
    text, lower, kind, role = (F.col(c) for c in ("content", "lower", "memory_type", "role"))
    df = df.withColumns({
        "n_tokens": F.size("tokens"), "n_tags": F.size("tags"),
        "sentiment": sc.sentiment(lower), "summary": summarize_140(text),
    })
    df = with_rounded(
        df,
        specificity=sc.specificity(text, F.col("n_tokens"), F.size("entities")),
        permanence=sc.permanence(lower, kind),
        actionability=sc.actionability(lower),
        signal_strength=sc.signal_strength(text, kind, F.col("n_tokens"), F.col("n_tags")))
    df = with_rounded(df, confidence=sc.confidence(
        lower, role, kind, F.col("n_tags"), F.col("specificity"), F.col("domain_confidence")))
    return with_rounded(df, extraction_importance=sc.base_importance(
        text, role, kind, F.col("created_at"), now,
        signal=F.col("signal_strength"), conf=F.col("confidence"), spec=F.col("specificity"),
        perm=F.col("permanence"), action=F.col("actionability"),
        domain_confidence=F.col("domain_confidence")))


def composite_importance(df: DataFrame, as_of, *, importance: str = "extraction_importance",
                         access_count=None, saved=None, mentions=None,
                         timestamp: str = "created_at", out: str = "importance") -> DataFrame:
    """Blend stored importance with recency, use, saving, mentions and length.

    Adds ``out`` and the components ``base, recency_part, frequency_part,
    saved_part, mention_part, length_part``.
    """
    parts = sc.composite_parts(
        F.col("content"), F.col("memory_type"), F.col(timestamp), as_timestamp(as_of),
        importance=F.col(importance),
        access_count=F.lit(0) if access_count is None else F.col(access_count),
        saved=F.lit(False) if saved is None else F.col(saved),
        mentions=F.lit(0) if mentions is None else F.col(mentions))
    staged = df.withColumns({f"_{k}": v for k, v in parts.items()})
    staged = with_rounded(staged, base=F.col("_base")).drop("_base")
    total = sc.composite_total({k: F.col("base" if k == "base" else f"_{k}") for k in parts})
    rounded = {k: F.col(f"_{k}") for k in parts if k not in ("base", "saved_part")}
    out_df = with_rounded(staged, **{out: total}, **rounded)
    out_df = out_df.withColumn("saved_part", F.col("_saved_part"))
    return out_df.drop(*[f"_{k}" for k in parts if k != "base"])


def gate_memories(df: DataFrame) -> DataFrame:
    """Keep rows worth storing."""
    return df.where(sc.is_storable(F.col("content"), F.col("role"), F.col("memory_type")))


def with_identity(df: DataFrame) -> DataFrame:
    """Deterministic id and the token-bag fingerprint."""
    return df.withColumns({
        "id": F.sha2(F.concat_ws(":", "event_id", F.col("segment_index").cast("string")), 256),
        "fingerprint": fingerprint(F.col("content")),
        "schema_version": F.lit(SCHEMA_VERSION),
        "generated_by": F.lit(GENERATED_BY),
        "extraction_method": F.lit(EXTRACTION_METHOD),
    })


#: columns of a memory row, in order
MEMORY_COLUMNS = [
    "id", "event_id", "segment_index", "session_id", "user_id", "role", "created_at",
    "memory_type", "content", "summary", "fingerprint", "importance", "confidence",
    "domain", "domain_confidence", "alternate_domains", "tags", "keywords", "entities",
    "sentiment", "signal_strength", "specificity", "permanence", "actionability",
    "classification_confidence", "alternatives", "n_factual", "n_episodic", "n_semantic",
    "extraction_importance", "schema_version", "generated_by", "extraction_method",
]


def annotate_segments(segments: DataFrame, as_of) -> DataFrame:
    """All inference and scoring stages over segment rows, without the gate."""
    df = with_tokens(segments)
    df = classify_with_confidence(df)
    df = infer_tags(infer_domain(df))
    df = extract_entities(infer_keywords(df))
    df = composite_importance(score_rows(df, as_of), as_of)
    return with_identity(df)


def extract_candidates(events: DataFrame, as_of) -> DataFrame:
    """Scored, gated memory rows of every event, before near-duplicate merging."""
    segments = segment_events(events)
    # type and gate first: rows that are dropped never reach the costlier stages
    gated = gate_memories(classify_type(with_tokens(segments)))
    gated = gated.select(*segments.columns)
    return annotate_segments(gated, as_of).select(*MEMORY_COLUMNS)


def extract_memories(events: DataFrame, as_of, threshold: float = 0.92) -> DataFrame:
    """The full extraction: candidates, then near-duplicates within an event merged."""
    from memlake.operators.dedup import dedup_within_event

    return dedup_within_event(extract_candidates(events, as_of), threshold)


# -- sessions --------------------------------------------------------------

def infer_session_state(events: DataFrame) -> DataFrame:
    """Latest topic, intent and mode per session, with its assistant turn count."""
    lower = F.lower("content")
    words = F.split(F.regexp_replace(lower, "[^a-z0-9]+", " "), " +")
    long_words = F.slice(F.filter(words, lambda w: F.length(w) > 3), 1, 6)
    topic = F.when(F.size(long_words) > 0, F.array_join(long_words, " ")).otherwise("general")
    from_user = F.col("role") == "user"
    state = F.struct(
        F.col("created_at").alias("last_activity_at"), F.col("event_id").alias("last_event_id"),
        topic.alias("current_topic"), F.substring("content", 1, 180).alias("last_user_intent"),
        sc.session_mode(lower).alias("mode"))
    latest = F.max_by(F.when(from_user, state),
                      F.when(from_user, F.struct("created_at", "event_id")))
    return (events.groupBy("session_id")
            .agg(latest.alias("state"),
                 F.count_if(F.col("role") == "assistant").alias("assistant_turns"))
            .select("session_id", "state.*", "assistant_turns"))


def recent_turns(events: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` events of every session, numbered oldest first."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    kept = events.withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= n)
    oldest = Window.partitionBy("session_id").orderBy("created_at", "event_id")
    return kept.withColumn("position", F.row_number().over(oldest)).drop("__back")


def assistant_turn_numbers(events: DataFrame) -> DataFrame:
    """Running count of assistant turns per session."""
    return with_running(events, ["session_id"], ["created_at", "event_id"],
                        assistant_turn=(F.col("role") == "assistant").cast("long"))
