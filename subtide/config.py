"""Every limit of the timeline and layout operators, in integer milliseconds and characters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Fixed values of layout.
    min_gap_ms: int = 80
    min_duration_ms: int = 700
    segment_floor_ms: int = 1000
    max_duration_ms: int = 6000
    anomaly_ms: int = 6001
    line_limit: int = 42
    line_soft: int = 38
    line_short: int = 8
    split_chars: int = 80
    split_target: int = 20
    readable_cps: int = 15
    gap_cps: int = 17
    cps_bands: tuple[int, int, int] = (20, 22, 25)
    start_pad_ms: int = -50
    start_pad_limit_ms: int = 50
    end_pad_ms: int = 100
    end_pad_limit_ms: int = 100
    layout_island_ms: int = 800
    trim_report_ms: int = 300
    # Fixed values of the completeness audit.
    audit_version: int = 2
    sample_rate: int = 16_000
    audit_island_ms: int = 2000
    min_speech_ms: int = 350
    min_uncovered_ms: int = 350
    window_pad_ms: int = 400
    window_join_ms: int = 200
    neighbour_ms: int = 2000
    max_windows: int = 20
    # Fixed values of cleaning up recognised rows.
    merge_gap_ms: int = 150
    merge_span_ms: int = 6000
    merge_chars: int = 36
    # Fixed values of learning terms and of translating.
    promote_after: int = 3
    context_before: int = 5
    context_after: int = 3
    batch_size: int = 10
    attempts: int = 4
    token_budgets: tuple[int, int] = (4096, 8192)
    compression_floor: float = 0.55
    # Fixed values of the validator.
    overlap_tolerance_us: int = 100
    short_cue_ms: int = 500


DEFAULT = EngineConfig()
