"""Schemas, versions and tunables of the two chart pipelines."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# Versions, and the names of axes, features, statistics and labels in the order of their codes.
STD_ANALYZER, MANIA_ANALYZER = 4, 1

CHARTS = "chart_id long, path string, content binary"
ATTRIBUTES = "sha256 string, aim double, speed double, reading double, stars double, max_combo int"

STD_AXES = ("aim", "speed", "reading", "slider", "overlap")
STD_BASE = ("bpm", "ar", "od", "cs", "hp", "length_seconds", "object_count", "object_density", "circle_ratio", "slider_ratio", "spinner_ratio", "max_combo")
OVERLAP_STATS = ("peak", "p95", "sustained_ratio", "stack_rate", "slider_occlusion_rate", "path_crossing_rate")

MANIA_AXES = ("speed", "hand_stream", "jack", "chordjack", "technical", "stamina", "long_note", "course")
PATTERNS = ("stream", "chordstream", "jacks", "coordination", "density", "wildcard")
STRUCTURE = ("chord_rate", "large_chord_rate", "rotation_rate", "anchor_rate", "rhythm_entropy", "transition_entropy", "ln_note_ratio", "hold_occupancy", "hybrid_row_ratio", "peak_to_sustain_gap")
MANIA_BASE = ("bpm", "length_seconds", "active_length_seconds", "note_count", "row_count", "avg_nps", "peak_nps", "break_density", "sv_change_rate")
FAMILIES = ("RC", "HB", "Mix", "LN")
PATTERN_LABELS = ("Stream", "Chordstream", "Jacks", "Coordination", "Density", "Wildcard")
KEY_COUNTS = (4, 6, 7)


@dataclass(frozen=True)
class OverlapConfig:
    """Tunables of the overlap dimension."""

    window_ms: float = 3000.0
    temporal_tau_ms: float = 700.0
    maximum_distance_ratio: float = 1.5
    stack_distance_ratio: float = 0.5
    circle_weight: float = 0.35
    slider_weight: float = 0.25
    ambiguity_weight: float = 0.15
    stack_weight: float = 0.15
    crossing_weight: float = 0.10
    strain_decay_base: float = 0.25
    section_ms: float = 400.0
    peak_weight_decay: float = 0.9


#: Weight of each base feature in the second distance, and the difference that counts as whole (None: as it is).
BASE_TERMS = {"bpm": (0.15, 300.0), "ar": (0.15, 10.0), "length_seconds": (0.10, 300.0), "object_density": (0.25, 10.0), "circle_ratio": (0.15, None), "slider_ratio": (0.20, None)}


@dataclass(frozen=True)
class Search:
    """Options of a search among free-aim charts.

    ``weights`` replaces weights of axes (else 1) and of base features by name.  ``bounds`` holds the least and the most value of columns, both included, None
    for no bound; they apply after candidates are chosen.
    """

    limit: int = 20
    candidates: int = 256
    weights: Mapping[str, float] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def weight(self, name: str) -> float:
        return self.weights.get(name, BASE_TERMS[name][0] if name in BASE_TERMS else 1.0)
