"""Settings of the transcript operators. Passed to transforms; never read from Spark's configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    overlap_threshold_ms: int = 200
    rapid_switch_threshold_ms: int = 150
    prev_short_turn_max_ms: int = 2_000
    min_response_ms: int = 600
    min_gap_ms: int = 250
    turn_gap_ms: int = 800
    word_gap_ms: int = 1_500
    merge_threshold: float = 0.82
    min_talk_seconds: float = 1.5
    similarity_threshold: float = 0.78
    margin_similarity: float = 0.62
    margin_delta: float = 0.15
    min_enroll_ms: int = 15_000
    min_update_ms: int = 3_000
    enable_turn_taking: bool = True
    enable_fillers: bool = True
    enable_linguistic: bool = True
    enable_meeting_type: bool = True
    voice_metrics: str = "optional"
    output_format: str = "json"
    output_detail: str = "standard"


DEFAULT = Config()


def resolved(given: Mapping[str, object] = {}, environment: Mapping[str, str] = {}, prefix: str = "SPEECHLAKE_") -> Config:
    """Settings as given, else from the environment (prefix and the name in capitals), else the default.

    None and, for texts, '' count as not given; 0 and False are values. An unknown name or a bad value raises.
    """
    known = {f.name: type(f.default) for f in fields(Config)}
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = {}
    for name, kind in known.items():
        value = given.get(name)
        if value is None or value == "":
            value = environment.get(prefix + name.upper()) or None
        if value is not None:
            if kind is bool and isinstance(value, str):
                if value.lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                    raise ValueError(f"{name} must be on or off, not {value!r}")
                value = value.lower() in ("1", "true", "yes", "on")
            out[name] = kind(value)
    return Config(**out)
