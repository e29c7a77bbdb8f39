"""Thresholds and profiles, and configuration files that extend one another."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Segmentation:
    """Bounds of a segment, in seconds and words."""

    max_gap_seconds: float = 0.65
    pad_seconds: float = 0.12
    min_words: int = 2
    min_duration: float = 2.0
    scene_cut_threshold: float = 0.30
    subtitle_end_pad_seconds: float = 0.60
    split_on_scene_cut: bool = True
    max_duration: float = 16.0


#: (metric, better when, accept bound, review bound, reason, only where lip sync is verified), in the order in which reasons are given.
CHECKS = (
    ("mouth_visible_ratio", "high", 0.88, 0.68, "mouth_not_visible_enough", False),
    ("scene_cut_ratio", "low", 0.015, 0.050, "scene_changes", False),
    ("static_speech_ratio", "low", 0.18, 0.42, "external_voice_or_dubbing", True),
    ("speech_mouth_motion_ratio", "high", 0.38, 0.22, "weak_mouth_motion_during_speech", True),
    ("lip_sync_correlation", "high", 0.05, 0.0, "weak_lip_audio_sync", True),
    ("max_missing_run_seconds", "low", 0.35, 1.00, "long_mouth_missing_interval", False),
    ("unstable_landmark_ratio", "low", 0.12, 0.35, "unstable_or_occluded_landmarks", False),
)


@dataclass(frozen=True)
class Visual:
    """How frames are sampled and judged."""

    mouth_opening_motion_floor: float = 0.0025
    landmark_jump_threshold: float = 0.18
    mouth_motion_floor: float = 0.018
    reject_voiceover_review_segments: bool = True
    audio_activity_quantile: float = 0.55
    sample_every_n_frames: int = 5
    mouth_shape_motion_floor: float = 0.0035
    reject_voiceover_segments_before_seconds: float = 15.0
    scene_cut_hist_threshold: float = 0.58


@dataclass(frozen=True)
class Speaker:
    """Face tracks and who of them speaks."""

    track_iou_threshold: float = 0.25
    review_min_speaking_ratio: float = 0.40
    sample_every_n_frames: int = 5
    min_speaking_probability: float = 0.60
    max_faces: int = 6
    accept_min_speaking_ratio: float = 0.65
    min_track_coverage: float = 0.80


@dataclass(frozen=True)
class Gate:
    """Bounds of the last decision on a clip."""

    min_sharpness: float = 18.0
    min_face_coverage: float = 0.80
    min_asr_confidence: float = 0.72
    min_active_speaker_score: float = 0.18


@dataclass(frozen=True)
class Transcription:
    max_no_speech_probability: float = 0.45
    automatic_probability: float = 0.82


@dataclass(frozen=True)
class Captions:
    languages: tuple[str, ...] = ("tr", "tr-TR")
    use_manual: bool = True
    use_automatic: bool = True


@dataclass(frozen=True)
class Settings:
    workspace: str = "data"
    language: str = "tr"
    segmentation: Segmentation = field(default_factory=Segmentation)
    visual_quality: Visual = field(default_factory=Visual)
    active_speaker: Speaker = field(default_factory=Speaker)
    quality: Gate = field(default_factory=Gate)
    transcription: Transcription = field(default_factory=Transcription)
    captions: Captions = field(default_factory=Captions)


#: Whether a profile verifies lip sync, which tells an outside voice from the one on screen.
PROFILES = {"no_voiceover": False, "voiceover": True}


def verifies_lip_sync(profile: str) -> bool:
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}; there are {sorted(PROFILES)}")
    return PROFILES[profile]


def overlay(base: dict, over: dict) -> dict:
    """`base` with what `over` has; sections merge, anything else is replaced."""
    both = {k: overlay(v, over[k]) if isinstance(v, dict) and isinstance(over.get(k), dict) else over.get(k, v) for k, v in base.items()}
    return both | {k: v for k, v in over.items() if k not in base}


def _build(kind: type, values: dict[str, Any]) -> Any:
    out = {}
    for f in fields(kind):
        if f.name in values:
            default = f.default_factory() if callable(f.default_factory) else f.default
            v = values[f.name]
            if is_dataclass(default):
                out[f.name] = _build(type(default), v or {})
            elif isinstance(default, tuple):
                out[f.name] = tuple(v)
            elif isinstance(default, bool) or not isinstance(default, (int, float)):
                out[f.name] = v
            else:
                out[f.name] = type(default)(v)
    return kind(**out)


def load(path: str | None = None) -> Settings:
    """Settings of a YAML file over those of the file it extends (one level); unknown keys are passed over. No path: the defaults."""
    if path is None:
        return Settings()
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    base = values.pop("extends", None)
    if base:
        with open(os.path.join(os.path.dirname(os.path.abspath(path)), str(base)), encoding="utf-8") as f:
            values = overlay(yaml.safe_load(f) or {}, values)
    return _build(Settings, values)


def flat(settings: Settings) -> dict[str, Any]:
    """Dotted names and values."""

    def walk(d: dict, at: str) -> dict:
        return {k: v for n, x in d.items() for k, v in (walk(x, f"{at}{n}.") if isinstance(x, dict) else {at + n: x}).items()}

    return walk(asdict(settings), "")


def first_of(*values: Any) -> Any:
    """The first value that is neither None nor empty: argument, then environment, then what was kept."""
    return next((v for v in values if v), None)


def device(wanted: str, *, cuda: bool = False, mps: bool = False) -> str:
    """`auto` is the best of what there is; anything else is taken as it is."""
    return wanted if wanted != "auto" else "cuda" if cuda else "mps" if mps else "cpu"
