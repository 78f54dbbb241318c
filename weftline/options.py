"""Every constant of retrieval, ingestion and tracing, as fields that a caller can override."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Relation prices, half-lives, markers and word lists that results depend on.
PRICES = {
    "AUTHORED": 0.95, "AUTHORED_BY": 0.95, "RESOLVES": 0.92, "REVIEWED": 0.85, "TOUCHES": 0.80, "PART_OF": 0.80, "REPORTED": 0.75, "MENTIONS": 0.60,
    "CO_OCCURS": 0.35,
}
HALF_LIFE_DAYS = {"Ticket": 21.0, "Issue": 21.0, "Commit": 45.0, "PR": 60.0, "PullRequest": 60.0, "File": 120.0, "Person": 180.0, "Service": 365.0, "Repo": 365.0}
RELATIONAL_MARKERS = (
    "who", "whom", "whose", "which", "what caused", "caused by", "because of", "related to", "connected to", "depends on", "owns", "owned by", "between",
    "path from", "linked to", "responsible for", "which pr", "which ticket",
)
SEMANTIC_MARKERS = (
    "explain", "architecture", "overview", "summary", "summarise", "summarize", "describe", "what is", "how does", "concept", "definition", "purpose of",
)
STOP_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "was", "were", "are", "has", "have", "not", "but", "its", "also", "into", "over", "after",
)
QUESTION_WORDS = ("who", "what", "when", "where", "which", "how", "why", "repo", "repository")


@dataclass(frozen=True)
class Options:
    """Defaults of one deployment."""

    prices: Mapping[str, float] = field(default_factory=lambda: dict(PRICES))
    generic_relation: str = "CO_OCCURS"
    half_life_days: Mapping[str, float] = field(default_factory=lambda: dict(HALF_LIFE_DAYS))
    default_half_life: float = 90.0
    recency_floor: float = 0.35
    weights: Mapping[str, tuple[float, float]] = field(default_factory=lambda: {"relational": (0.15, 0.85), "semantic": (0.80, 0.20)})
    max_hops: int = 2
    max_degree: int = 10
    k_graph: int = 10
    router_k: int = 5
    total_k: int = 10
    min_vector_k: int = 2
    seed_similarity: float = 0.35
    seed_top: int = 3
    merge_at: float = 0.92
    ask_at: float = 0.85
    find_at: float = 0.80
    impact_hops: int = 4
    impact_rows: int = 50
    impact_first_cap: int = 200
    impact_k: int = 25
    chunk_chars: int = 1200
    chunk_overlap: int = 150
    window_words: int = 300
    window_overlap: int = 50
    used_at: float = 0.2
    debounce_window: int = 120
    debounce_wait: int = 600
    heartbeat_s: int = 120


DEFAULTS = Options()
