"""Thresholds and weights, with the defaults of the product; each can be overridden by environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


def from_env(cls, prefix: str, environ=None):
    """An instance of a frozen dataclass of numbers, overridden by `PREFIX_FIELD` where that is a number."""
    environ = os.environ if environ is None else environ
    found = {}
    for f in fields(cls):
        try:
            found[f.name] = type(f.default)(float(environ[f"{prefix}_{f.name.upper()}"]))
        except (KeyError, ValueError):
            continue
    return cls(**found)


@dataclass(frozen=True)
class DedupThresholds:
    """Distances and similarities of the duplicate detector."""

    hash_distance: int = 4
    confirmed: float = 0.93
    gray_high: float = 0.90
    gray_low: float = 0.86
    gray_seq_distance: int = 6
    gray_hash_distance: int = 8
    strict: float = 0.92
    dense: float = 0.90
    top_k: int = 50
    blur: float = 15.0
    clear: float = 50.0
    technical_blur: float = 25.0


@dataclass(frozen=True)
class VideoThresholds:
    """Scores and durations of video segmentation."""

    severe_blur: float = 20.0
    severe_shake: float = 15.0
    exposure_low: float = 10.0
    exposure_high: float = 100.0
    blurry: float = 50.0
    shaky: float = 30.0
    slightly_shaky: float = 60.0
    segment_seconds: float = 2.0
    cut_margin: float = 0.5
    scene: float = 0.3
    min_segment: float = 2.0
    score_proximity: float = 0.10
    adjacency_gap: float = 2.0
    over_target: float = 1.1


@dataclass(frozen=True)
class QualityWeights:
    """Shares of the six dimensions in the overall score, and the cap of unsharp images."""

    sharpness: float = 0.45
    exposure: float = 0.10
    contrast: float = 0.10
    resolution: float = 0.15
    noise: float = 0.10
    file_size: float = 0.10
    veto_below: float = 0.15
    veto_cap: float = 0.20
