"""Segmentation, classification and scores on literal rows."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memlake.functions import scoring as sc
from memlake.functions import text as tx
from memlake.operators import dedup, extract

NOW = "2026-04-21 12:00:00"


def events(spark, *rows):
    data = [(f"event-{i}", "session-1", "user-1", role, content, at)
            for i, (role, content, at) in enumerate(rows)]
    return spark.createDataFrame(
        data, "event_id string, session_id string, user_id string, role string, content string, created_at string"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))


def extracted(spark, *rows):
    return extract.extract_memories(events(spark, *rows), NOW).collect()


def test_identity_statement(spark):
    (row,) = extracted(spark, (
        "user", "On Sundays I prefer planning the orchard project in 2 long walks, and my name is Orlaith", "2026-04-21 10:00:00"))
    assert row.memory_type == "factual" and row.domain == "identity"
    assert row.confidence > 0.7 and row.importance > 0.7
    assert "identity" in row.tags and "preference" in row.tags
    assert {"type": "name_or_title", "value": "Orlaith"} in [e.asDict() for e in row.entities]
    assert row.schema_version == 3


def test_gate(spark):
    rows = extracted(
        spark, ("user", "ok", NOW), ("user", "thanks", NOW), ("user", "What do you remember about me?", NOW),
        ("assistant", "That is a lovely thing to say to anybody.", NOW),
        ("assistant", "We should plan the next step together today.", NOW),
        ("assistant", "Helper demo response: we should plan the next step.", NOW),
        ("user", "Water is wet here.", NOW))
    assert [r.content for r in rows] == ["We should plan the next step together today."]


def test_segments_keep_order_and_drop_blanks(spark):
    df = extract.segment_events(events(spark, ("user", "  First one.  Second one!\n\nThird?   ", NOW)))
    assert [(r.segment_index, r.content) for r in df.orderBy("segment_index").collect()] == [
        (0, "First one."), (1, "Second one!"), (2, "Third?")]


def test_repeated_sentence_is_merged(spark):
    rows = extracted(spark, ("user", "I prefer green tea in the morning.\nI prefer green tea in the morning!", NOW))
    assert len(rows) == 1 and rows[0].segment_index == 0


def test_event_merge_matches_plain_greedy(spark):
    texts = [
        "I prefer green tea in the morning always.", "I prefer green tea in the morning, always!",
        "We decided to use Redis for the job queue.", "I like tea.", "I like teas.", "I like tea",
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my name is",
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu my name is",
    ]
    df = extract.extract_candidates(events(spark, ("user", "\n".join(texts), NOW)), NOW)
    candidates = [r.content for r in df.orderBy("segment_index").collect()]
    norms = {r.content: r.n for r in df.select("content", tx.normalize_text(F.col("content")).alias("n")).collect()}
    kept = []
    for text in candidates:
        for i, old in enumerate(kept):
            a, b = norms[text], norms[old]
            if tx.pair_similarity(a, b, tx.distinct_tokens(a), tx.distinct_tokens(b)) >= 0.92:
                kept[i] = text if len(text) > len(old) else old
                break
        else:
            kept.append(text)
    merged = dedup.dedup_within_event(df).orderBy("segment_index").collect()
    assert [r.content for r in merged] == kept
    assert len(kept) < len(candidates)


@pytest.mark.parametrize("text, expected", [
    ("hi", True), ("Thanks!", True), ("how are you", False), ("nice work", True), ("deploy the build", False)])
def test_small_talk(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string").select(sc.is_small_talk(F.col("t")).alias("x"))
    assert df.first().x is expected


@pytest.mark.parametrize("a, b, expected", [
    ("I live in Mumbai", "I live in Bangalore", 0.45), ("", "", 1.0), ("the", "a", 0.0),
    ("don't deploy on Friday evenings", "do not deploy on Friday evenings", 1.0),
    ("We use PostgreSQL for our backend database.", "We use MongoDB for our backend database.", 0.6)])
def test_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "text_a string, text_b string")
    value = dedup.text_similarity(df).first().similarity
    na, nb = df.select(tx.normalize_text(F.col("text_a")), tx.normalize_text(F.col("text_b"))).first()
    assert value == tx.pair_similarity(na, nb, tx.distinct_tokens(na), tx.distinct_tokens(nb))
    assert abs(value - expected) < 0.06


def exact_two_decimals(x: float) -> float:
    """Nearest hundredth of the exact binary value, larger one on a tie."""
    scaled = Fraction(x) * 100
    return int(scaled + Fraction(1, 2)) / 100


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.floats(0, 1), st.integers(0, 1000).map(lambda n: n / 1000)))
def test_rounding_value(x):
    assert tx.round2_value(x) == exact_two_decimals(x)


def test_rounding_column(spark):
    values = [n / 1000 for n in range(1001)] + [-0.5, 1.7, 0.58 + 0.036 + 0.114]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", tx.round2(F.col("x")).alias("r"))
    for row in df.collect():
        assert row.r == exact_two_decimals(min(1.0, max(0.0, row.x)))


def test_scores_stay_in_range(spark):
    text = "Maybe we should fix the login bug today? " * 12
    for row in extracted(spark, ("user", text, "2020-01-01 00:00:00"), ("user", "I am 5. I like it a lot!", NOW)):
        for name in ("importance", "confidence", "specificity", "permanence", "actionability", "signal_strength"):
            assert 0 <= row[name] <= 1


def test_keywords_rank_repeats_first(spark):
    df = spark.createDataFrame([("redis cache redis stores cache redis", )], "content string")
    row = extract.infer_keywords(extract.with_tokens(df)).first()
    assert row.keywords == ["redis", "cache", "stores"]
