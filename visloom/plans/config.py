"""Imaging parameters from a JSON file: sections are merged, named overrides win, and values out of range fall back."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from typing import Any

# Algorithms and, beyond the common ones, the sections that each reads.
COMMON = ["flag", "weighting", "computing", "nufft", "ROP"]
ALGORITHMS = {"airi": ["airi", "airi_default"], "cairi": ["cairi", "cairi_default"], "usara": ["usara", "usara_default"]}


def load(path: str, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """One flat table of the file's sections; an override counts only for a key of section ``main`` (and the shelf's path)."""
    with open(path, encoding="utf-8") as f:
        sections = {k: v for part in json.load(f) for k, v in part.items() if k != "__comment"}
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    out = {**sections["main"], **{k: v for k, v in given.items() if k in sections["main"]}}
    if out.get("algorithm") not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {out.get('algorithm')!r}")
    for name in COMMON + ALGORITHMS[out["algorithm"]]:
        if name in sections or name != "ROP":
            out.update({k: v for k, v in sections[name].items() if "_comment_" not in k})
    if "dnn_shelf_path" in given:
        out["dnn_shelf_path"] = given["dnn_shelf_path"]
    return out


@dataclass(frozen=True)
class Imaging:
    """Parameters with their defaults; ``checked`` puts the default in the place of a value that is missing or out of range."""

    im_dim_x: int = 512
    im_dim_y: int = 512
    superresolution: float = 1.0
    flag_data_weighting: bool = True
    weight_load: bool = True
    weight_type: str = "briggs"
    weight_robustness: float = 0.0
    weight_gridsize: float = 2.0
    im_min_itr: int = 200
    im_max_itr: int = 2000
    im_var_tol: float = 1e-5
    im_max_outer_itr: int = 20
    im_var_outer_tol: float = 1e-3
    heu_noise_scale: float = 1.0

    @classmethod
    def checked(cls, given: dict[str, Any]) -> "Imaging":
        base = cls()
        known = {f.name: given[f.name] for f in fields(cls) if given.get(f.name) is not None}
        positive = [n for n in known if n not in ("flag_data_weighting", "weight_load", "weight_type", "weight_robustness")]
        kept = {n: v for n, v in known.items() if n not in positive or v > 0}
        if kept.get("superresolution", 1.0) < 1:
            raise ValueError("superresolution is at least 1")
        if kept.get("weight_type", "briggs") not in ("briggs", "robust", "uniform"):
            kept["weight_type"] = base.weight_type
        return replace(base, **kept)


def prefix(algorithm: str, source: str, scale: float = 1.0, run: int | None = None) -> str:
    """Name that a run's outputs start with."""
    return "_".join([source, algorithm] + ([f"scale_{scale:g}"] if scale != 1.0 else []) + ([f"run_{run}"] if run is not None else []))
