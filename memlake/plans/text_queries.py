"""Registered queries for segmentation, classification and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import scoring as sc
from memlake.functions import text as tx
from memlake.functions.text import round6
from memlake.operators import dedup, extract
from memlake.plans import inputs

KEYS = ["event_id", "segment_index"]


def joined(column: str, name: str | None = None):
    return F.array_join(column, "|").alias(name or column)


def entity_list():
    return F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit(":"), e["value"])),
                        "|").alias("entities")


def p01_segment_events(spark, sf_dir):
    return extract.segment_events(inputs.chat_events(spark, sf_dir)).select(*KEYS, "content")


def p02_tokenize(spark, sf_dir):
    return inputs.segments(spark, sf_dir).select(*KEYS, joined("tokens"), F.size("tokens").alias("n"))


def p03_normalize_text(spark, sf_dir):
    return inputs.segments(spark, sf_dir).select(*KEYS, tx.normalize_text(F.col("content")).alias("norm"))


def p04_classify_type(spark, sf_dir):
    return extract.classify_type(inputs.segments(spark, sf_dir)).select(
        *KEYS, "n_factual", "n_episodic", "n_semantic", "memory_type")


def p05_classify_with_confidence(spark, sf_dir):
    df = extract.classify_with_confidence(inputs.segments(spark, sf_dir))
    first, second = F.get("alternatives", F.lit(0)), F.get("alternatives", F.lit(1))
    return df.select(*KEYS, "memory_type", "classification_confidence",
                     first["type"].alias("alt1"), first["confidence"].alias("alt1_confidence"),
                     second["type"].alias("alt2"), second["confidence"].alias("alt2_confidence"))


def p06_infer_domain(spark, sf_dir):
    return extract.infer_domain(inputs.segments(spark, sf_dir)).select(
        *KEYS, "domain", "domain_confidence", joined("alternate_domains"))


def p07_infer_tags(spark, sf_dir):
    return extract.infer_tags(inputs.segments(spark, sf_dir)).select(*KEYS, joined("tags"))


def p08_infer_keywords(spark, sf_dir):
    return inputs.candidates(spark, sf_dir).select("id", joined("keywords"))


def p09_extract_entities(spark, sf_dir):
    return extract.extract_entities(inputs.segments(spark, sf_dir)).select(*KEYS, entity_list())


def _annotated(spark, sf_dir, *columns):
    segs = extract.segment_events(inputs.chat_events(spark, sf_dir))
    return extract.annotate_segments(segs, inputs.AS_OF).select(*KEYS, *columns)


def p10_score_specificity(spark, sf_dir):
    return _annotated(spark, sf_dir, "specificity")


def p11_score_permanence(spark, sf_dir):
    return _annotated(spark, sf_dir, "permanence")


def p12_score_actionability(spark, sf_dir):
    return _annotated(spark, sf_dir, "actionability")


def p13_infer_sentiment(spark, sf_dir):
    return _annotated(spark, sf_dir, "sentiment")


def p14_score_signal_strength(spark, sf_dir):
    return _annotated(spark, sf_dir, "signal_strength")


def p15_score_confidence(spark, sf_dir):
    return _annotated(spark, sf_dir, "confidence")


def p16_score_importance(spark, sf_dir):
    return _annotated(spark, sf_dir, "extraction_importance")


def p17_composite_importance(spark, sf_dir):
    df = extract.composite_importance(
        inputs.stored(spark, sf_dir).drop("importance"), inputs.AS_OF,
        access_count="access_count", saved="saved", mentions="n_semantic")
    return df.select("id", "importance", "base", "recency_part", "frequency_part", "saved_part",
                     "mention_part", "length_part")


def p18_gate_memories(spark, sf_dir):
    df = extract.gate_memories(extract.classify_type(inputs.segments(spark, sf_dir)))
    return df.select(*KEYS, "role", "memory_type")


def p19_is_small_talk(spark, sf_dir):
    return inputs.segments(spark, sf_dir).where(sc.is_small_talk(F.col("content"))).select(*KEYS, "content")


def p20_summarize_140(spark, sf_dir):
    return inputs.segments(spark, sf_dir).select(
        *KEYS, tx.summarize_140(F.col("content")).alias("summary"))


def p21_fingerprint(spark, sf_dir):
    return inputs.segments(spark, sf_dir).select(
        *KEYS, tx.fingerprint(F.col("content")).alias("fingerprint"))


def p22_extract_memories(spark, sf_dir):
    df = extract.extract_memories(inputs.chat_events(spark, sf_dir), inputs.AS_OF)
    return df.select("id", "event_id", "segment_index", "session_id", "memory_type", "content",
                     "importance", "confidence", "domain", joined("tags"), joined("keywords"),
                     entity_list())


def p22_extract_candidates(spark, sf_dir):
    return inputs.candidates(spark, sf_dir).select(
        "id", "event_id", "segment_index", "session_id", "user_id", "memory_type", "content",
        "summary", "fingerprint", "importance", "confidence", "domain", "domain_confidence",
        joined("alternate_domains"), joined("tags"), joined("keywords"), entity_list(),
        "sentiment", "signal_strength", "specificity", "permanence", "actionability",
        "classification_confidence")


def p23_infer_session_state(spark, sf_dir):
    return extract.infer_session_state(inputs.chat_events(spark, sf_dir)).select(
        "session_id", "last_event_id", "current_topic", "last_user_intent", "mode",
        "assistant_turns")


def p24_importance_level(spark, sf_dir):
    df = inputs.candidates(spark, sf_dir)
    return (df.groupBy(sc.importance_level(F.col("importance")).alias("level"))
            .agg(F.count("*").alias("memories")))


def w01_recent_turns(spark, sf_dir):
    return extract.recent_turns(inputs.chat_events(spark, sf_dir), 6).select(
        "session_id", "event_id", "position")


def w02_top_memories_per_session(spark, sf_dir):
    """The five most important memories of each session."""
    from memlake.operators.windows import top_k

    df = dedup.dedup_fingerprint(inputs.candidates(spark, sf_dir))
    return top_k(df, ["session_id"], [F.desc("importance"), F.asc("id")], 5).select(
        "session_id", "rank", "id", "importance", "memory_type", "domain")


def w03_top_memories(spark, sf_dir):
    """The twenty most important memories over all sessions."""
    df = inputs.candidates(spark, sf_dir)
    return df.orderBy(F.desc("importance"), F.asc("id")).limit(20).select(
        "id", "importance", "memory_type")


def w07_assistant_turn_numbers(spark, sf_dir):
    return extract.assistant_turn_numbers(inputs.chat_events(spark, sf_dir)).select(
        "event_id", "assistant_turn")


QUERIES = {name: fn for name, fn in list(globals().items())
           if name[:1] in "pw" and name[1:3].isdigit()}
