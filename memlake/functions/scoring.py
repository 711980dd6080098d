"""Column builders for classification, scores and gates of one memory row.

Scores are returned unrounded unless noted; callers stage them and round with
:func:`memlake.functions.text.with_rounded`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions import lexicon as lx
from memlake.functions.text import (
    contains_any, count_contained, count_matching, hours_between, matches, trim_space,
)


def _bonus(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


# -- type ------------------------------------------------------------------

def type_counts(lower: Column) -> dict[str, Column]:
    return {
        "n_factual": count_matching(lower, lx.FACTUAL_PATTERNS),
        "n_episodic": count_matching(lower, lx.EPISODIC_PATTERNS),
        "n_semantic": count_matching(lower, lx.SEMANTIC_PATTERNS),
    }


def memory_type(n_factual: Column, n_episodic: Column) -> Column:
    return (F.when((n_factual > 0) & (n_factual >= n_episodic), "factual")
            .when(n_episodic > 0, "episodic").otherwise("semantic"))


# -- domain ----------------------------------------------------------------

def scored_domains(lower: Column) -> Column:
    """Domains with a positive score, best first, rule order on ties."""
    entries = [
        F.struct(
            (-F.least(F.lit(1.0), F.lit(weight) * count_contained(lower, terms))).alias("neg"),
            F.lit(i).alias("rule"),
            F.lit(name).alias("domain"))
        for i, (name, weight, terms) in enumerate(lx.DOMAIN_RULES)
    ]
    return F.sort_array(F.filter(F.array(*entries), lambda e: e["neg"] < 0))


def _names(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["domain"])


def domain_columns(lower: Column, scored: Column) -> dict[str, Column]:
    """``domain``, raw ``domain_confidence`` and ``alternate_domains``."""
    identity = matches(lower, lx.IDENTITY_SHORTCUT)
    preference = matches(lower, lx.PREFERENCE_SHORTCUT)
    best = F.get(scored, F.lit(0))
    others = lambda name: F.slice(F.filter(scored, lambda e: e["domain"] != name), 1, 3)
    return {
        "domain": F.when(identity, "identity").when(preference, "preference")
        .otherwise(F.coalesce(best["domain"], F.lit("general"))),
        "domain_confidence": F.when(identity, 0.95).when(preference, 0.9)
        .when(best.isNotNull(), F.least(F.lit(0.95), -best["neg"])).otherwise(0.35),
        "alternate_domains": F.when(identity, _names(others("identity")))
        .when(preference, _names(others("preference")))
        .otherwise(_names(F.slice(scored, 2, 3))),
    }


# -- tags, keywords, entities ----------------------------------------------

def tags(lower: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(contains_any(lower, terms), F.lit(tag)) for tag, terms in lx.TAG_RULES]))


def sorted_terms(tokens: Column) -> Column:
    """(term, position) of terms with three characters or more, sorted."""
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return F.sort_array(F.filter(placed, lambda e: F.length(e["term"]) >= 3))


def term_starts(terms: Column) -> Column:
    """Indexes at which a new term begins in :func:`sorted_terms` output."""
    indexes = F.sequence(F.lit(0), F.size(terms) - 1)
    first = lambda i: (i == 0) | (F.get(terms, i)["term"] != F.get(terms, i - 1)["term"])
    return F.when(F.size(terms) > 0, F.filter(indexes, first)).otherwise(
        F.array().cast("array<int>"))


def ranked_terms(terms: Column, starts: Column, n_tokens: Column) -> Column:
    """(−score, −count, first position, term) of each distinct term, best first."""
    def entry(start, j):
        following = F.coalesce(F.get(starts, j + 1), F.size(terms))
        count = (following - start).cast("double")
        share = count / n_tokens
        spread = share * F.log(share + 1)
        score = share * F.log(F.lit(1.0) + F.lit(1.0) / count) * (F.lit(1.0) - spread * 0.1)
        head = F.get(terms, start)
        return F.struct((-score).alias("neg"), (-count).alias("negc"),
                        head["pos"].alias("pos"), head["term"].alias("term"))
    return F.sort_array(F.transform(starts, entry))


def _labelled(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))


def entities(text: Column) -> Column:
    """Up to ten distinct ``type:value`` strings, in pattern order then text order."""
    parts = []
    for kind, ignore_case, pattern in lx.ENTITY_PATTERNS:
        found = F.regexp_extract_all(text, F.lit(lx.jvm_regex(pattern, ignore_case)), F.lit(0))
        marks = lx.ENTITY_MARKS.get(kind)
        if marks:
            found = F.when(contains_any(text, marks), found).otherwise(
                F.array().cast("array<string>"))
        parts.append(_labelled(kind, found))
    names = F.regexp_extract_all(text, F.lit(lx.jvm_regex(lx.PROPER_NAME_PATTERN)), F.lit(0))
    names = F.filter(names, lambda v: ~v.isin(lx.IGNORED_NAMES))
    parts.append(_labelled("name_or_title", names))
    return F.slice(F.array_distinct(F.concat(*parts)), 1, lx.MAX_ENTITIES)


def entity_type(entry: Column) -> Column:
    return F.substring_index(entry, ":", 1)


def entity_value(entry: Column) -> Column:
    return entry.substr(F.length(entity_type(entry)) + 2, F.length(entry))


# -- scores of one text ----------------------------------------------------

def specificity(text: Column, n_tokens: Column, n_entities: Column) -> Column:
    return (F.lit(0.2)
            + _bonus(n_tokens >= 6, 0.15) + _bonus(n_tokens >= 14, 0.12)
            + _bonus(n_entities > 0, 0.18)
            + _bonus(matches(text, lx.NUMBER_PATTERN), 0.12)
            + _bonus(matches(text, lx.REASON_PATTERN, True), 0.14))


def permanence(lower: Column, kind: Column) -> Column:
    base = F.when(kind == "factual", 0.68).when(kind == "semantic", 0.54).otherwise(0.42)
    return (base + _bonus(contains_any(lower, lx.STABLE_TERMS), 0.18)
            - _bonus(contains_any(lower, lx.TEMPORAL_TERMS), 0.14)
            + _bonus(contains_any(lower, lx.LASTING_TERMS), 0.08))


def actionability(lower: Column) -> Column:
    return (F.lit(0.15) + _bonus(contains_any(lower, lx.ACTION_TERMS), 0.35)
            + _bonus(contains_any(lower, lx.PLANNING_TERMS), 0.2)
            - _bonus(F.contains(lower, F.lit("?")), 0.1))


def sentiment(lower: Column) -> Column:
    positive = count_contained(lower, lx.POSITIVE_TERMS)
    negative = count_contained(lower, lx.NEGATIVE_TERMS)
    return (F.when(positive > negative, "positive").when(negative > positive, "negative")
            .otherwise("neutral"))


def is_low_signal(text: Column) -> Column:
    plain = trim_space(F.lower(text))
    return plain.isin(lx.LOW_SIGNAL_PHRASES) | (F.length(plain) < 8)


def signal_strength(text: Column, kind: Column, n_tokens: Column, n_tags: Column) -> Column:
    return (F.lit(0.25)
            + F.when(kind == "factual", 0.2).when(kind == "episodic", 0.14).otherwise(0.08)
            + F.least(F.lit(0.16), n_tokens * 0.01) + F.least(F.lit(0.16), n_tags * 0.04)
            - _bonus(is_low_signal(text), 0.3)
            - _bonus(matches(text, lx.HEDGE_PATTERN, True), 0.08))


def confidence(lower: Column, role: Column, kind: Column, n_tags: Column,
               specificity_score: Column, domain_confidence: Column) -> Column:
    facts = count_contained(lower, lx.FACT_TERMS)
    hedges = count_contained(lower, lx.UNCERTAIN_TERMS)
    aimless = (role == "assistant") & ~matches(lower, lx.DECISION_PATTERN)
    return (F.when(role == "user", 0.58).otherwise(0.44)
            + specificity_score * 0.18 + domain_confidence * 0.12
            + F.least(F.lit(0.08), n_tags * 0.02)
            + _bonus(kind == "factual", 0.08)
            + F.least(F.lit(0.12), facts * 0.05)
            - _bonus(F.contains(lower, F.lit("?")), 0.16)
            - F.least(F.lit(0.2), hedges * 0.08)
            - _bonus(aimless, 0.08))


def base_importance(text: Column, role: Column, kind: Column, timestamp: Column, as_of: Column, *,
                    signal: Column, conf: Column, spec: Column, perm: Column, action: Column,
                    domain_confidence: Column) -> Column:
    """Extraction-time importance; episodic rows fade with age."""
    score = (signal * 0.28 + conf * 0.20 + spec * 0.16 + perm * 0.16 + action * 0.12
             + domain_confidence * 0.08
             + _bonus(role == "user", 0.06)
             + _bonus(kind == "factual", 0.08) + _bonus(kind == "episodic", 0.04)
             + _bonus(matches(text, lx.KEY_WORD_PATTERN, True), 0.08)
             + _bonus(F.length(text) > 220, 0.03)
             - _bonus(F.endswith(trim_space(text), F.lit("?")), 0.08))
    age = hours_between(timestamp, as_of)
    fade = F.exp(F.lit(-0.015) * F.least(age, F.lit(720.0)))
    return score * F.when((kind == "episodic") & timestamp.isNotNull(), fade).otherwise(1.0)


def composite_parts(text: Column, kind: Column, timestamp: Column, as_of: Column, *,
                    importance: Column, access_count: Column, saved: Column,
                    mentions: Column) -> dict[str, Column]:
    """Components of the composite importance, unrounded, keyed by name."""
    age = F.least(F.greatest(F.lit(0.0), hours_between(timestamp, as_of)), F.lit(720.0))
    recency = (F.when(timestamp.isNull(), 0.5).when(kind == "factual", 1.0)
               .otherwise(F.exp(F.lit(-(math.log(2) / 72)) * age)))
    count = F.greatest(F.lit(0), F.coalesce(access_count, F.lit(0)))
    mention = F.greatest(F.lit(0), F.coalesce(mentions, F.lit(0)))
    return {
        "base": F.coalesce(importance, F.lit(0.5)),
        "recency_part": recency,
        "frequency_part": F.least(F.lit(1.0), F.log1p(count) / F.lit(math.log1p(20))),
        "saved_part": F.when(F.coalesce(saved, F.lit(False)), 0.15).otherwise(0.0),
        "mention_part": F.least(F.lit(1.0), F.log1p(mention) / F.lit(math.log1p(10))),
        "length_part": F.least(F.lit(1.0), F.length(text) / F.lit(400.0)),
    }


def composite_total(parts: dict[str, Column]) -> Column:
    return (parts["base"] * 0.60 + parts["recency_part"] * 0.15 + parts["frequency_part"] * 0.10
            + parts["saved_part"] + parts["mention_part"] * 0.08 + parts["length_part"] * 0.05)


def importance_level(score: Column) -> Column:
    return (F.when(score >= 0.75, "critical").when(score >= 0.5, "high")
            .when(score >= 0.25, "medium").otherwise("low"))


# -- gates -----------------------------------------------------------------

def is_storable(text: Column, role: Column, kind: Column) -> Column:
    """True for rows worth keeping."""
    plain = trim_space(F.lower(text))
    question = F.lit(False)
    for prefix in lx.MEMORY_QUERY_PREFIXES:
        question = question | F.startswith(plain, F.lit(prefix))
    canned = matches(plain, lx.DEMO_REPLY_PATTERN) | F.contains(
        plain, F.lit(lx.FALLBACK_REPLY_NOTICE))
    keep = (F.when(role == "assistant", ~canned & contains_any(plain, lx.ASSISTANT_KEEP_TERMS))
            # the type (many patterns) is only needed for short texts
            .otherwise((F.length(plain) > 24) | (kind != "semantic")))
    return ~is_low_signal(text) & ~question & keep


def is_small_talk(text: Column, words: list[str] = lx.SMALL_TALK_WORDS) -> Column:
    """At most two words, one of the greeting terms among them."""
    plain = F.regexp_replace(F.lower(trim_space(text)), f"[^a-z0-9{lx.WHITE_SPACE}]", "")
    n_words = F.size(F.split(plain, f"[{lx.WHITE_SPACE}]+"))
    return (n_words <= 2) & contains_any(plain, words)


def session_mode(lower: Column) -> Column:
    return (F.when(contains_any(lower, ["implement", "code", "fix"]), "implementation")
            .when(contains_any(lower, ["architecture", "design"]), "architecture")
            .when(contains_any(lower, ["how", "why", "what"]), "explanation")
            .otherwise("conversation"))
