"""Settings: defaults, files, environment and call, each laid over the one before."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

#: Defaults of the commands.
DEFAULTS = {
    "index": {"bank": {"kmer": 21, "scaled": 1000, "nb_hash": 0}, "pangenome": {"kmer": 21, "min_count": 1}},
    "search": {"bank": {"mode": "containment", "threshold_pangenome": 0.05, "threshold_genome": 0.01, "gather": False}, "pangenome": {"min_fraction": 0.7}},
    "profile": {
        "stop_rule": "cv_paired", "k_max": 12, "merge_jaccard": 0.95, "cv_folds": 5, "cv_min_gain": 0.02, "refine": True,
        "impute_min_frac": 0.5, "reassign_max_residual": 0.5, "gather_threshold": 0.05, "min_fraction": 0.15,
    },
    "cache": {"add": {"kmer": 25}},
}


def merge(base: Mapping, over: Mapping) -> dict:
    """base with the values of over; sections are merged, values are replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def read(path: str | os.PathLike) -> dict:
    """Settings of a TOML, JSON or YAML file."""
    path = Path(path)
    if path.suffix == ".toml":
        return tomllib.loads(path.read_text())
    if path.suffix == ".json":
        return json.loads(path.read_text())
    if path.suffix in (".yaml", ".yml"):
        import yaml  # optional

        return yaml.safe_load(path.read_text()) or {}
    raise ValueError(f"unknown kind of settings: {path.name}")


def from_environment(prefix: str = "HELIXLAKE", environ: Mapping[str, str] | None = None, known: Mapping = DEFAULTS) -> dict:
    """Settings of variables PREFIX_SECTION_..._NAME that name a known value, read as JSON where possible."""
    environ, out = os.environ if environ is None else environ, {}

    def visit(section: Mapping, path: list[str], into: dict) -> None:
        for key, value in section.items():
            if isinstance(value, Mapping):
                visit(value, [*path, key], into.setdefault(key, {}))
            elif (name := "_".join([prefix, *path, key]).upper()) in environ:
                try:
                    into[key] = json.loads(environ[name])
                except ValueError:
                    into[key] = environ[name]

    visit(known, [], out)
    return out


def check(settings: Mapping, known: Mapping = DEFAULTS, path: str = "") -> None:
    """Raise on unknown names and on values of another type than the default's."""
    for key, value in settings.items():
        at = f"{path}{key}"
        if key not in known:
            raise ValueError(f"unknown setting {at}")
        if isinstance(known[key], Mapping):
            if not isinstance(value, Mapping):
                raise ValueError(f"{at} is a section")
            check(value, known[key], f"{at}.")
        elif isinstance(known[key], bool) != isinstance(value, bool) or not isinstance(value, (int, float) if isinstance(known[key], float) else type(known[key])):
            raise ValueError(f"{at} must be of type {type(known[key]).__name__}")


def load(layers: list[tuple[str, Mapping]]) -> tuple[dict, dict[str, str]]:
    """Settings after all named layers, and for each value the layer that it comes from."""
    out, origin = DEFAULTS, {}

    def note(section: Mapping, name: str, path: str = "") -> None:
        for key, value in section.items():
            if isinstance(value, Mapping):
                note(value, name, f"{path}{key}.")
            else:
                origin[f"{path}{key}"] = name

    note(DEFAULTS, "defaults")
    for name, layer in layers:
        check(layer)
        out = merge(out, layer)
        note(layer, name)
    return out, origin
