"""Settings of the command line: what is given there goes before a file's, and that before the usual ones."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """The usual values. In a file they stand alone or under the name of a section, which is not looked at."""

    voxel_size: float = 0.05
    camera_range: float = 3.0
    density_weight: float = 0.6
    coverage_weight: float = 0.4
    high_threshold: float = 0.7
    low_threshold: float = 0.3
    dead_threshold: float = 0.3
    min_zone_voxels: int = 200


def read_settings(path: str | None, given: dict | None = None) -> Settings:
    """Settings of a JSON or YAML file (YAML where its library is installed) under those given; None counts as not given.

    Unknown names are left out; a value that is no number of its kind is an error.
    """
    held: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            found = json.loads(text)
        except json.JSONDecodeError:
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path} is no JSON, and YAML cannot be read here") from e
            found = yaml.safe_load(text) or {}
        for name, value in found.items():
            held |= value if isinstance(value, dict) else {name: value}
    held |= {k: v for k, v in (given or {}).items() if v is not None}
    return Settings(**{f.name: type(f.default)(held[f.name]) for f in fields(Settings) if f.name in held})
