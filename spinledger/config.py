"""Operator settings, with their published default values."""

from __future__ import annotations

import math
from dataclasses import dataclass

# The tempo variants tried by the matcher.
TEMPO_SCALES = (0.90, 0.925, 0.95, 0.975, 1.0, 1.025, 1.05, 1.075, 1.10)


@dataclass(frozen=True)
class FingerprintConfig:
    sample_rate: int = 11_025
    window_size: int = 2_048
    hop_size: int = 512
    min_frequency_hz: float = 80.0
    max_frequency_hz: float = 4_500.0
    bin_radius: int = 4
    frame_radius: int = 2
    frame_floor_db: float = -28.0
    clip_floor_db: float = -52.0
    max_peaks_per_frame: int = 10
    min_delta_frames: int = 1
    max_delta_frames: int = 42
    fanout: int = 7
    ratio_quantization: int = 48
    ratio_tolerance: int = 1
    delta_tolerance: int = 1

    @property
    def first_bin(self) -> int:
        return max(1, math.ceil(self.min_frequency_hz * self.window_size / self.sample_rate))

    @property
    def last_bin(self) -> int:
        top = math.floor(self.max_frequency_hz * self.window_size / self.sample_rate)
        return min(self.window_size // 2, top)


@dataclass(frozen=True)
class MatcherConfig:
    min_votes: int = 8
    limit: int = 5
    tempo_scales: tuple[float, ...] = TEMPO_SCALES


@dataclass(frozen=True)
class SegmenterConfig:
    sample_rate: int = 11_025
    window_size: int = 1_024
    hop_size: int = 512
    min_confidence: float = 0.35
    max_gap_seconds: float = 12.0
    min_play_seconds: float = 15.0
    boundary_gap_seconds: float = 8.0
    boundary_merge_seconds: float = 5.0
    smoothing_radius: int = 2
    mad_multiplier: float = 3.0

    @property
    def frame_seconds(self) -> float:
        return self.hop_size / self.sample_rate
