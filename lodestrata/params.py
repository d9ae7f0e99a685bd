"""Tunable constants of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Defaults that results depend on.
    accept: float = 0.62
    subprofile: float = 0.42
    found_sec: float = 4.0
    link_accept: float = 0.75
    keep_exemplar: float = 0.72
    min_corroboration: int = 4
    name_inherit_share: float = 0.5
    cover: float = 0.80
    max_profiles: int = 24
    min_enroll_sec: float = 10.0
    min_link_sec: float = 60.0
    min_core: float = 2.0
    durable_s: float = 6.0
    guard: int = 10
    min_cluster_sec: float = 10.0
    weak_min: float = 0.35
    fallback_thr: float = 0.2656
    low_span: float = 0.25
    low_dominance: float = 2.0
    covered_enough: float = 0.5
    words_enough: float = 0.8
    coverage_min: float = 0.95
    silence_db: float = -70.0
    window_s: float = 30.0
    single_pass_s: float = (131072 - 512) / (12.5 + 20)
    inset_s: float = 0.20
    min_dur: float = 0.50
    max_dur: float = 20.0
    per_speaker: int = 2
    clips: int = 3
    clip_min: float = 1.5
    clip_max: float = 12.0
    near_name_edits: int = 2


DEFAULTS = Params()
