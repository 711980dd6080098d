"""Default thresholds.  Every operator takes the matching dataclass as a keyword."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TopicalPenalty:
    enabled: bool = False
    low_threshold: float = 0.10
    high_threshold: float = 0.25
    low_penalty: float = 0.30
    medium_penalty: float = 0.60


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 8
    vector_weight: float = 0.5
    lexical_weight: float = 0.2
    importance_weight: float = 0.2
    recency_weight: float = 0.1
    recency_half_life_hours: float = 72.0
    dedup_threshold: float = 0.92
    summary_every_n_turns: int = 20
    session_bonus: float = 0.04
    min_score: float = 0.05
    min_importance_without_match: float = 0.65
    penalty: TopicalPenalty = field(default_factory=TopicalPenalty)


@dataclass(frozen=True)
class HybridWeights:
    vector: float = 0.40
    keyword: float = 0.20
    importance: float = 0.20
    recency: float = 0.10
    graph: float = 0.10

    def clamped(self) -> "HybridWeights":
        return HybridWeights(*(
            max(0.0, min(1.0, float(w)))
            for w in (self.vector, self.keyword, self.importance, self.recency, self.graph)
        ))


@dataclass(frozen=True)
class LifecycleConfig:
    stale_access_days: float = 30
    stale_importance_min: float = 0.30
    archive_access_days: float = 120
    archive_importance_max: float = 0.40
    conflict_similarity: float = 0.25
    conflict_confidence_min: float = 0.50
    duplicate_similarity: float = 0.92
    stale_penalty: float = 0.60
    conflict_penalty: float = 0.80


@dataclass(frozen=True)
class ConsolidationConfig:
    min_sources: int = 2
    max_sources: int = 20
    conflict_similarity_high: float = 0.88
    conflict_similarity_low: float = 0.25
    reconsolidate_fraction: float = 0.30
    stale_fraction: float = 0.60
    #: rows of a bucket that one task goes through at a time; groups don't depend on it
    window_rows: int = 50_000


@dataclass(frozen=True)
class GraphConfig:
    min_importance: float = 0.45
    min_confidence: float = 0.55
    max_keywords: int = 8
    max_entities: int = 6
