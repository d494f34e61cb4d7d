"""Settings of a run: defaults, a YAML file, the environment and overrides, merged in this order and checked."""

from __future__ import annotations

import copy
import os
from pathlib import Path
from typing import Any

#: The effective defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "audio": {"frame_ms": 20, "segment_s": 1.0},
    "d1": {"n_lfcc": 20, "n_filters": 40},
    "d2": {"windows": [8, 16, 32], "windows_B": [4, 8, 16], "modes": ["bit", "block"], "directions": ["fwd", "bwd"], "chi2_orders": [1, 2, 4], "train_frac": 0.8, "max_train": 5000, "mlp_lr": 0.001, "max_iter": 200, "seed": 42, "alpha": 0.01, "robust": False},
    "fusion": {"sprt_alpha": 0.01, "sprt_beta": 0.05, "t_max_s": 60.0},
    "engine": {"stream_d2_checks": "reduced"},
}


def merged(base: dict, over: dict, at: str = "") -> dict:
    """base with over's values; a key that base has not, or a section for a value, is an error."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if k not in base:
            raise ValueError(f"unknown setting {at}{k}")
        if isinstance(base[k], dict) != isinstance(v, dict):
            raise ValueError(f"{at}{k} must {'' if isinstance(base[k], dict) else 'not '}be a section")
        out[k] = merged(base[k], v, f"{at}{k}.") if isinstance(v, dict) else v
    return out


def load(path: str | None = None, overrides: dict | None = None, variable: str = "SEQLOOM_CONFIG") -> dict:
    """path, or the file that the environment's variable names, over the defaults; overrides over both."""
    out = DEFAULTS
    path = path or os.environ.get(variable)
    if path:
        import yaml

        out = merged(out, yaml.safe_load(Path(path).read_text()) or {})
    return merged(out, overrides or {})
