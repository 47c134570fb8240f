"""Limits and thresholds, with their defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    """Fixed values of the extraction service; a limit of 0 or None means that there is none."""

    max_file_bytes: int = 104_857_600
    max_files_per_message: int = 10
    max_pdf_pages: int = 300
    max_ocr_pages_per_pdf: int = 150
    max_ocr_pages_per_job: int = 200
    ocr_always_pages: int = 5
    bytes_per_page: int = 50_000
    ocr_pages_per_chunk: int = 2
    direct_ocr_max_pages: int = 10
    direct_ocr_chars_per_page: int = 80
    jobs_max_concurrency: int = 1
    jobs_max_queue: int = 100
    jobs_stale_ms: int = 3_600_000
    jobs_retention_ms: int = 24 * 3_600_000
    maintenance_seconds: int = 60


@dataclass(frozen=True)
class OcrKnobs:
    """Fixed values that choose among OCR attempts and rotations, and settings of what prepares images."""

    max_attempts: int = 2
    mode: int = 4
    second_mode: int = 6
    scale: int = 100
    deskew: float = 40.0
    adaptive_threshold: str = "35x35+10%"
    lat: str = "20x20+10%"
    threshold: str = "55%"
    good_confidence: float = 78.0
    good_words: int = 30
    good_chars: int = 300
    rotate: bool = False
    rotate_angles: str = "90,270"
    rotate_max_attempts: int = 1
    rotate_min_gain: float = 8.0
    rotate_min_words: int = 10
    weak_words: int = 5
    weak_confidence: float = 50.0
    weak_chars: int = 30


def env_int(env: Mapping[str, str], name: str, default: int) -> int:
    """A whole number above 0, read up to the first other character; else the default."""
    digits = ""
    for c in env.get(name, "").strip():
        if not c.isdigit():
            break
        digits += c
    return int(digits) if digits and int(digits) > 0 else default


def env_float(env: Mapping[str, str], name: str, default: float) -> float:
    try:
        value = float(env.get(name, ""))
    except ValueError:
        return default
    return value if value == value and abs(value) != float("inf") else default


def env_bool(env: Mapping[str, str], name: str, default: bool) -> bool:
    value = env.get(name)
    return default if value is None or not value.strip() else value.strip().lower() in ("1", "true", "yes", "on")


def limits_from_env(env: Mapping[str, str] | None = None, prefix: str = "PAGEMILL_") -> Limits:
    env = os.environ if env is None else env
    return Limits(**{f.name: env_int(env, prefix + f.name.upper(), f.default) for f in fields(Limits)})


def knobs_from_env(env: Mapping[str, str] | None = None, prefix: str = "PAGEMILL_OCR_") -> OcrKnobs:
    """Whole numbers must be above 0, as env_int has it; a text that is blank is the default."""
    env = os.environ if env is None else env

    def value(name: str, default):
        if isinstance(default, bool):
            return env_bool(env, name, default)
        if isinstance(default, int):
            return env_int(env, name, default)
        if isinstance(default, float):
            return env_float(env, name, default)
        return env.get(name, "").strip() or default

    return OcrKnobs(**{f.name: value(prefix + f.name.upper(), f.default) for f in fields(OcrKnobs)})
