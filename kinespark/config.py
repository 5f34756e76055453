"""The quality contract: strict settings from YAML, and the options of rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from .errors import ConfigError

NAME = "kinespark.yaml"
SEVERITIES = ("critical", "error", "warning", "notice")


@dataclass
class RuleSettings:
    enabled: bool = True
    severity: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class ReportSettings:
    json: bool = True
    junit: bool = False
    sarif: bool = False
    html: bool = False
    output_dir: str = ".kinespark/reports"


@dataclass
class CacheSettings:
    enabled: bool = True
    directory: str = ".kinespark/cache"


@dataclass
class Config:
    config_version: int = 1
    adapter: str = "auto"
    profile: str = "auto"
    required_streams: list[str] = field(default_factory=lambda: ["observation.state", "action"])
    fail_on: str = "error"
    rules: dict[str, RuleSettings] = field(default_factory=dict)
    reports: ReportSettings = field(default_factory=ReportSettings)
    cache: CacheSettings = field(default_factory=CacheSettings)
    baseline: str | None = None
    plugins: list[str] = field(default_factory=list)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _filled(kind: type, raw: Any, where: str):
    if not isinstance(raw, dict):
        raise ConfigError(f"{where} must be a mapping")
    known = {f.name for f in fields(kind)}
    if unknown := set(map(str, raw)) - known:
        raise ConfigError(f"{where} has unknown entries: {', '.join(sorted(unknown))}")
    return kind(**raw)


def _texts(value: Any, where: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{where} must be a list of names")
    if len(set(value)) < len(value):
        raise ConfigError(f"{where} must not repeat a name")
    return value


def from_mapping(raw: Any) -> Config:
    config = _filled(Config, raw, "the configuration")
    for name, allowed in (("config_version", (1,)), ("adapter", ("auto", "lerobot", "mcap")), ("profile", ("auto", "generic", "ros2")), ("fail_on", SEVERITIES)):
        if getattr(config, name) not in allowed:
            raise ConfigError(f"{name} must be one of {', '.join(map(str, allowed))}")
    _texts(config.required_streams, "required_streams")
    _texts(config.plugins, "plugins")
    if not isinstance(config.rules, dict):
        raise ConfigError("rules must be a mapping")
    config.rules = {k: v if isinstance(v, RuleSettings) else _filled(RuleSettings, v, f"rules.{k}") for k, v in config.rules.items()}
    for k, v in config.rules.items():
        if v.severity is not None and v.severity not in SEVERITIES:
            raise ConfigError(f"rules.{k}.severity must be one of {', '.join(SEVERITIES)}")
        if not isinstance(v.enabled, bool) or not isinstance(v.options, dict):
            raise ConfigError(f"rules.{k}: enabled must be true or false, and options a mapping")
    for name, kind in (("reports", ReportSettings), ("cache", CacheSettings)):
        if not isinstance(getattr(config, name), kind):
            setattr(config, name, _filled(kind, getattr(config, name), name))
    return config


def find(path: str | None, source: str | None = None) -> Path | None:
    """The file named; else one beside the source; else one in the working folder."""
    if path is not None:
        return Path(path)
    folders = [Path.cwd()]
    if source and "://" not in source:
        at = Path(source)
        folders.insert(0, at if at.is_dir() else at.parent)
    return next((f / NAME for f in folders if (f / NAME).is_file()), None)


def load(path: str | None = None, source: str | None = None) -> Config:
    at = find(path, source)
    if at is None:
        return Config()
    try:
        raw = yaml.safe_load(at.read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{at} cannot be read: {e}") from e
    return from_mapping(raw)


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _whole(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


#: What the values of options must be, by name; names not here are not tested.
_KINDS: list[tuple[str, str, Callable[[Any], bool]]] = [
    ("max_findings stride min_messages max_idle_samples min_moving_transitions min_episodes lag_tolerance_frames", "a positive whole number", lambda v: _whole(v) and v > 0),
    ("max_consecutive_frames frame_count_tolerance", "a whole number from 0", lambda v: _whole(v) and v >= 0),
    (
        """tolerance_fraction max_gap_multiplier max_delay_ms max_cell_difference min_repeat_fraction min_changed_ratio max_mean_intensity max_stddev
        motion_delta_threshold min_run_displacement max_header_skew_ms max_reorder_ms tolerance_frames step_factor min_range_fraction spread_factor
        min_varying_fraction noise_ratio min_usual_correlation max_drop min_strength max_relative_distance max_drift_frames idle_abs_tolerance max_gap_ms""",
        "a number from 0", lambda v: v is None or (_number(v) and v >= 0),
    ),
    ("min_motion_fraction", "a number from 0 to 1", lambda v: _number(v) and 0 <= v <= 1),
    ("required_streams streams motion_streams required_topics", "a list of names", lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)),
    ("limits max_delta", "a mapping by stream", lambda v: isinstance(v, dict)),
    ("topic_rates_hz", "a mapping of positive numbers", lambda v: isinstance(v, dict) and all(_number(x) and x > 0 for x in v.values())),
]


def check_options(rule_id: str, options: dict[str, Any]) -> None:
    for names, what, fine in _KINDS:
        for name in names.split():
            if name in options and not fine(options[name]):
                raise ConfigError(f"{rule_id}.{name} must be {what}")


DEFAULT = f"""# {NAME}: the quality contract of a recording
config_version: 1
adapter: auto
profile: auto
required_streams: [observation.state, action]
fail_on: error
rules:
  temporal.max_gap:
    options: {{max_gap_multiplier: 2.0}}
reports: {{json: true, junit: false, sarif: false, html: false, output_dir: .kinespark/reports}}
cache: {{enabled: true, directory: .kinespark/cache}}
"""
