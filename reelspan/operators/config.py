"""Parameters with their bounds, and strict reading of them."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any, TypeVar


class ConfigFault(ValueError):
    """A parameter is missing, unknown or out of its bounds."""


def _check(good: bool, text: str) -> None:
    if not good:
        raise ConfigFault(text)


def _whole(value: Any, least: int, name: str) -> None:
    _check(isinstance(value, int) and not isinstance(value, bool) and value >= least, f"{name} must be a whole number of at least {least}")


def _finite(value: Any, least: float, name: str, above: bool = False) -> None:
    good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    _check(good and (value > least if above else value >= least), f"{name} must be a finite number {'above' if above else 'of at least'} {least}")


@dataclass(frozen=True)
class RetrievalConfig:
    candidate_depth: int = 500
    result_limit: int = 100
    temporal_window: int = 0
    max_results_per_video: int | None = None

    def __post_init__(self) -> None:
        _whole(self.result_limit, 1, "result_limit")
        _whole(self.candidate_depth, self.result_limit, "candidate_depth")
        _whole(self.temporal_window, 0, "temporal_window")
        _check(self.result_limit <= 100, "result_limit is at most 100")
        if self.max_results_per_video is not None:
            _whole(self.max_results_per_video, 1, "max_results_per_video")


@dataclass(frozen=True)
class HybridConfig:
    enabled: bool = False
    raw_depth: int = 500
    auxiliary_depth: int = 300
    ocr_depth: int = 100
    raw_weight: float = 2.0
    holistic_weight: float = 1.5
    clause_weight: float = 1.0
    event_weight: float = 1.0
    ocr_weight: float = 0.75
    rrf_k: int = 60
    planner_seconds: float = 3.0
    temporal_enabled: bool = True
    max_frame_gap: int = 9_000
    gap_penalty: float = 0.25
    full_bonus: float = 1.0
    boost_weight: float = 1.0
    ocr_enabled: bool = True
    fuzzy_threshold: float = 0.72

    def __post_init__(self) -> None:
        for name in ("raw_depth", "auxiliary_depth", "ocr_depth", "rrf_k", "max_frame_gap"):
            _whole(getattr(self, name), 1, name)
        for name in ("raw_weight", "holistic_weight", "clause_weight", "event_weight", "ocr_weight", "planner_seconds"):
            _finite(getattr(self, name), 0, name, above=True)
        for name in ("gap_penalty", "full_bonus", "boost_weight", "fuzzy_threshold"):
            _finite(getattr(self, name), 0, name)
        _check(self.fuzzy_threshold <= 1, "fuzzy_threshold is at most 1")

    def weight(self, kind: str) -> float:
        return {"raw": self.raw_weight, "holistic": self.holistic_weight, "clause": self.clause_weight, "event": self.event_weight, "ocr": self.ocr_weight}[kind]


@dataclass(frozen=True)
class AlignmentConfig:
    gap_penalty: float = 0.01
    candidates_per_event: int = 50
    max_videos: int = 100
    max_paths: int = 100

    def __post_init__(self) -> None:
        _finite(self.gap_penalty, 0, "gap_penalty")
        for name in ("candidates_per_event", "max_videos", "max_paths"):
            _whole(getattr(self, name), 1, name)


@dataclass(frozen=True)
class EvidenceConfig:
    window_seconds: float = 4.0
    max_windows: int = 20
    seeds_per_video: int = 3
    samples: int = 5
    near_seed_radius: int = 0
    refine_seconds: float = 1.0
    max_refined: int = 20

    def __post_init__(self) -> None:
        for name in ("window_seconds", "refine_seconds"):
            _finite(getattr(self, name), 0, name, above=True)
        for name in ("max_windows", "seeds_per_video", "samples", "max_refined"):
            _whole(getattr(self, name), 1, name)
        _whole(self.near_seed_radius, 0, "near_seed_radius")


@dataclass(frozen=True)
class RerankerConfig:
    enabled: bool = False
    positive_weight: float = 0.0
    negative_weight: float = 0.0
    object_weight: float = 0.0
    budget_seconds: float = 1.5

    def __post_init__(self) -> None:
        weights = (self.positive_weight, self.negative_weight, self.object_weight)
        for value in weights:
            _finite(value, 0, "a re-ranking weight")
        _finite(self.budget_seconds, 0, "budget_seconds", above=True)
        _check(not self.enabled or any(weights), "an enabled re-ranker needs a weight")


@dataclass(frozen=True)
class EncoderConfig:
    model_id: str
    revision: str
    dimension: int = 64

    def __post_init__(self) -> None:
        _check(bool(self.model_id), "model_id is empty")
        _check(re.fullmatch("[0-9a-f]{40}", self.revision) is not None, "revision must be 40 lower-case hexadecimal digits")
        _whole(self.dimension, 1, "dimension")


C = TypeVar("C")


def load(kind: type[C], source: str | Path | dict) -> C:
    """A configuration from a JSON file or object; unknown fields are refused."""
    found = source if isinstance(source, dict) else json.loads(Path(source).read_text(encoding="utf-8-sig"))
    _check(isinstance(found, dict), "a configuration is one JSON object")
    names = {f.name for f in fields(kind)}  # type: ignore[arg-type]
    _check(set(found) <= names, f"unknown fields: {sorted(set(found) - names)}")
    try:
        return kind(**found)
    except TypeError as fault:
        raise ConfigFault(str(fault)) from fault
