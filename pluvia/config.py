"""Run configuration: defaults, merged with JSON; dictionaries merge, lists and scalars replace.

Rain sources are ``{"name": weight}`` or ``{"name": {"kind", "path", "variable", "value", "select", "mode", "weight"}}``.
"""

from __future__ import annotations

import copy
import json
from pathlib import Path

#: The defaults of a run.
DEFAULTS = {
    "model": {"T_s": 7200.0, "dt_s": 5.0, "encoding": "esri", "ia_ratio": 0.2, "particle_vol_m3": 0.25, "travel_time_s": 5.0, "travel_time_channel_s": 1.0, "outflow_sink": True, "routing": "auto"},
    "travel_time_auto": {"enabled": False, "hillslope_velocity_ms": 0.5, "channel_velocity_ms": 1.5, "min_s": 0.25, "max_s": 3600.0},
    "rain": {"sources": {}, "select": "previous", "mode": "intensity_mmph", "weight": 1.0},
    "risk": {"balance": 0.55, "p_low": 5.0, "p_high": 95.0},
    "restart": {"every": 120, "read": None, "strict_grid": True},
    "output": {"save_every_s": 0.0, "rotate_every_s": 0.0, "outflow_interval_s": 3600.0, "variables": "all", "fill": -9999.0, "inundation_threshold_m": 0.01},
}
VARIABLES = ["flood_depth", "risk_index", "inundation_mask", "flood_depth_max", "inundation_mask_max"]


def merged(base: dict, more: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str | None = None, **override) -> dict:
    return merged(merged(DEFAULTS, json.loads(Path(path).read_text()) if path else {}), override)


def output_variables(choice) -> list[str]:
    """The output variables of None, "all" or a list; an error for empty lists, unknown names and what is no text."""
    if choice is None or choice == "all":
        return list(VARIABLES)
    names = [choice] if isinstance(choice, str) else list(choice)
    if not names or not all(isinstance(n, str) for n in names) or set(names) - set(VARIABLES):
        raise ValueError(f"output variables {choice!r} are not among {VARIABLES}")
    return list(dict.fromkeys(names))


KINDS = ("netcdf", "scalar", "table")


def rain_sources(cfg: dict, names: list[str] | None = None) -> dict[str, dict]:
    """Every rain source with all its options. Without any in the configuration, ``names`` with the defaults.

    A source that is described without a weight has weight 0 and is not read; a scalar needs its value.
    """
    rain = cfg["rain"]
    given = rain["sources"] or {n: rain["weight"] for n in names or []}
    out = {}
    for name, x in given.items():
        x = dict(x) if isinstance(x, dict) else {"kind": "table", "weight": x}
        one = {"kind": "netcdf", "path": None, "variable": "rain_rate", "value": None, "select": rain["select"], "mode": rain["mode"], "weight": 0.0} | x
        if one["kind"] not in KINDS:
            raise ValueError(f"rain source {name!r}: unknown kind {one['kind']!r}")
        if one["kind"] == "scalar" and one["value"] is None:
            raise ValueError(f"rain source {name!r}: a scalar needs a value")
        if one["kind"] == "netcdf" and not one["path"]:
            raise ValueError(f"rain source {name!r}: a path is missing")
        out[name] = one
    return out
