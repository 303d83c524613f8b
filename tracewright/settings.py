"""Constants of the jobs, in one place; pass a changed copy where a job takes ``settings``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed values, needed for equal results."""

    gap_seconds: int = 2700
    min_messages: int = 3
    max_messages: int = 60
    trust_time: bool = True
    degenerate_p90_seconds: float = 120.0
    solo_min_words: int = 4
    trigger_reactions: tuple[str, ...] = ("bookmark", "pushpin", "memo", "warning", "fire", "rotating_light")
    default_tier: int = 2
    lookback_days: int = 14
    code_chars: int = 8000
    summary_fallback_chars: int = 600
    exact_cap: int = 3
    prefetch: int = 30
    fusion_limit: int = 20
    rerank_input: int = 20
    rerank_output: int = 5
    floor_ratio: float = 0.85
    symbol_min_chars: int = 4
    time_sigma_seconds: float = 60 * 24 * 3600.0
    time_floor: float = 0.3
    author_boost: float = 1.25
    tier_weights: tuple[tuple[int, float], ...] = ((1, 1.5), (2, 1.0), (3, 0.7))
    bookmark_boost: float = 1.2
    null_threshold: float = 0.7121
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    field_boosts: tuple[tuple[str, float], ...] = (("summary", 2.0), ("raw_text", 1.0), ("symbols", 1.5))
    workspace: str = "acme"
    history_limit: int = 25
    recent_limit: int = 5
    body_lines: int = 120


DEFAULTS = Settings()
