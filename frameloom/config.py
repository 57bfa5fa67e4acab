"""Thresholds and limits, read once from the environment into an immutable value."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

OBSERVED, DOCUMENTED = "observed", "documented"


@dataclass(frozen=True)
class Config:
    """``profile`` "observed" gives the verdicts that the service's code gives; "documented" what its manual
    promises where the two differ (brightness by luminance, a real recompression check)."""

    profile: str = OBSERVED
    max_upload_bytes: int = 15 * 1024 * 1024
    blur_threshold: float = 100.0
    blur_box: int = 800
    low_light: float = 60.0
    overexposed: float = 200.0
    min_width: int = 400
    min_height: int = 300
    near_distance: int = 5
    near_window: int = 500
    ela_quality: int = 90
    ela_ratio: float = 40.0
    max_attempts: int = 3
    backoff_ms: int = 2000
    reason_length: int = 500
    sample_length: int = 120
    page_size: int = 20
    max_page: int = 100
    keep_done_s: int = 3600
    keep_done_rows: int = 1000
    keep_failed_s: int = 24 * 3600

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "FRAMELOOM_") -> Config:
        """Each field from its variable; unset, empty and non-finite values leave the default, "0" and negatives count."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if f.name == "profile":
                if raw in (OBSERVED, DOCUMENTED):
                    found["profile"] = raw
                continue
            value = number_or(raw, f.default)
            found[f.name] = int(value) if isinstance(f.default, int) else float(value)
        return cls(**found)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def number_or(raw: str | None, default: float) -> float:
    if raw is None or not raw.strip():
        return default
    try:
        value = float(raw)
    except ValueError:
        return default
    return value if math.isfinite(value) else default
