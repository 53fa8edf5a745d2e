"""Settings of the fact store; each default leaves optional features off."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    budget: int = 300
    max_entries: int = 500
    max_chars: int = 120
    min_chars: int = 8
    similarity: float = 0.6
    floor: float = 0.5
    floor_max_knots: int = 200
    length_norm: float = 0.5
    reference_length: int = 40
    subject_focus: float = 0.4
    importance_rank: float = 0.0
    association_weight: float = 0.5
    reserve: float = 0.0
    burst_seconds: int = 120
    burst_weight: float = 0.0
    index_terms: int = 0
    index_weight: float = 0.35
    index_df_ceiling: float = 0.02
    coverage_gate: float = 0.0
    bridge_k: int = 6
    bridge_k_wide: int = 30
    bridge_multiplier: float = 1.875
    bridge_candidates: int = 200
    same_turn: float = 1.0
    adjacent: float = 0.55
    cord_share: float = 0.5
    min_cord: float = 0.3
    weave_min_word: int = 4
    weave_min_count: int = 4
    weave_min_pair: int = 3
    weave_neighbours: int = 12
    weave_window: int = 12


DEFAULT = Config()
