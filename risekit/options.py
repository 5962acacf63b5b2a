"""Options as dataclasses, with their defaults, read from mappings or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class AnalysisOptions:
    slope_window_minutes: float = 40.0
    reset_drop_fraction: float = 0.25
    min_samples_for_fit: int = 8
    max_eta_relative_std_error: float = 0.15
    peak_confirm_windows: int = 3
    max_session_hours: float = 36.0
    median_window_size: int = 5
    peak_fraction: float = 0.97
    flat_slope_percent_per_hour: float = 0.5
    min_rise_percent_for_peak: float = 25.0
    max_rise_px_per_minute: float = 4.0
    jitter_tolerance_px: float = 6.0
    max_implausible_jump_rejects: int = 2
    collapse_confirm_samples: int = 3
    #: Restored sessions lose the median window, streaks and warm start, as a state file does.
    legacy_restore: bool = False


@dataclass(frozen=True)
class SnapshotOptions:
    snapshot_url: str | None = None
    base_url: str = ""
    camera: str = ""
    access_token: str | None = None
    sample_interval_minutes: float = 1.0
    retry_count: int = 2
    retry_delay_seconds: float = 5.0
    timeout_seconds: float = 5.0
    roi_x: int | None = None
    roi_y: int | None = None
    roi_width: int | None = None
    roi_height: int | None = None


@dataclass(frozen=True)
class VisionOptions:
    wall_min_length_fraction: float = 0.08
    min_width_fraction: float = 0.04
    retention_hours: float = 48.0
    save_debug_images: bool = True


@dataclass(frozen=True)
class PublishOptions:
    host: str = ""
    port: int = 1883
    device_id: str = "rise_monitor"
    discovery_prefix: str = "homeassistant"
    debug_mode: bool = False


@dataclass(frozen=True)
class MonitorOptions:
    analysis: AnalysisOptions = field(default_factory=AnalysisOptions)
    snapshot: SnapshotOptions = field(default_factory=SnapshotOptions)
    vision: VisionOptions = field(default_factory=VisionOptions)
    publish: PublishOptions = field(default_factory=PublishOptions)


def _typed(cls, values: Mapping[str, object]):
    """cls from the values that it has a field for; strings take the type of the default."""
    out = {}
    for f in fields(cls):
        if f.name in values:
            v, default = values[f.name], f.default
            if isinstance(v, str) and isinstance(default, bool):
                v = v.strip().lower() in {"1", "true", "yes", "on"}
            elif isinstance(v, str) and isinstance(default, (int, float)):
                v = type(default)(v)
            out[f.name] = v
    return cls(**out)


def monitor_options(config: Mapping[str, Mapping[str, object]] | None) -> MonitorOptions:
    """Options from a nested mapping with the sections analysis, snapshot, vision and publish; None is an error."""
    if config is None:
        raise ValueError("the monitor section is missing")
    parts = {f.name: f.default_factory for f in fields(MonitorOptions)}
    return MonitorOptions(**{name: _typed(cls, config.get(name, {})) for name, cls in parts.items()})


def from_environment(prefix: str = "MONITOR", env: Mapping[str, str] | None = None) -> MonitorOptions:
    """Options from variables such as MONITOR__ANALYSIS__MEDIAN_WINDOW_SIZE."""
    config: dict[str, dict[str, str]] = {}
    for key, value in (os.environ if env is None else env).items():
        parts = key.split("__")
        if len(parts) == 3 and parts[0].upper() == prefix:
            config.setdefault(parts[1].lower(), {})[parts[2].lower()] = value
    return monitor_options(config)
