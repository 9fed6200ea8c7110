"""Layered settings on the driver: later layers win key by key, names are dotted."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings a step has by itself.
DEFAULTS: dict[str, Any] = {
    "seed": 42,
    "deliberation": {"rounds": 5, "simulations": 5, "threshold": 0.0},
    "preferences": {"min_delta": 0.0},
    "generation": {"max_tokens": 256, "temperature": 0.7, "top_p": 0.9},
    "training": {"iterations": 1, "patience": None, "min_improvement": 0.0},
}


#: Folders of settings files, in the order in which they win.
GROUPS = ("model", "data", "train")


class MissingSetting(KeyError):
    """A required setting is in no layer."""


def merged(*layers: Mapping[str, Any] | None) -> dict[str, Any]:
    """One tree of all layers; mappings are merged, anything else replaces what was there."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def read_settings(path: str | Path) -> dict[str, Any]:
    """A JSON file, or YAML where a parser is installed; must hold a mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if found is None:
        return {}
    if not isinstance(found, Mapping):
        raise ValueError(f"{path} holds no mapping")
    return dict(found)


def resolve(defaults: Mapping[str, Any], common: Mapping[str, Any] | None = None, step: Mapping[str, Any] | None = None, shared: set[str] | None = None) -> dict[str, Any]:
    """Flat defaults under common settings (those of shared names only) under the step's; nulls and unknown names change nothing."""
    out = dict(defaults)
    for layer, names in ((common, shared), (step, None)):
        out |= {k: v for k, v in (layer or {}).items() if k in defaults and v is not None and (names is None or k in names)}
    return out


def resolve_column(defaults: Column, common: Column, step: Column, shared: tuple[str, ...]) -> Column:
    """resolve row by row, over maps: settings that differ from row to row."""
    of = lambda layer, k: F.try_element_at(layer, k)
    from_common = lambda k: F.when(k.isin(*shared), of(common, k))
    return F.transform_values(defaults, lambda k, v: F.coalesce(of(step, k), from_common(k), v))


def merged_layers(rows: DataFrame, scope: list[str], name: str, order: list[str], value: str) -> DataFrame:
    """Layers as rows, merged by scope: each name has the value of the last layer that has one; layers without one change nothing."""
    there = rows.where(F.col(name).isNotNull() & F.col(value).isNotNull())
    return there.groupBy(*scope, name).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("layers"))


class Settings:
    """A tree of settings with dotted names."""

    def __init__(self, *layers: Mapping[str, Any] | None):
        self._tree = merged(*layers)

    @classmethod
    def of_files(cls, *paths: str | Path, overrides: Mapping[str, Any] | None = None) -> Settings:
        return cls(DEFAULTS, *map(read_settings, paths), overrides)

    @classmethod
    def of_groups(cls, root: str | Path, groups: Mapping[str, str | None] | None = None, experiment: str | Path | None = None, overrides: Iterable[str] = ()) -> Settings:
        """Six layers: DEFAULTS, root/default, a file of each group (model, data, train in this order), the experiment's file, `a.b=value` overrides.

        Files are JSON or YAML; a layer without a file is left out. Values of overrides are JSON where they can be read so, else text.
        """
        chosen = [Path(root) / "default", *(Path(root) / g / n for g in GROUPS if (n := (groups or {}).get(g)))]
        unknown = set(groups or {}) - set(GROUPS)
        if unknown:
            raise ValueError(f"unknown groups {sorted(unknown)}")
        found = [f for x in chosen if (f := next((x.with_name(x.name + e) for e in (".json", ".yaml") if x.with_name(x.name + e).exists()), None))]
        layers = [read_settings(f) for f in found] + ([read_settings(experiment)] if experiment and Path(experiment).exists() else [])
        out = cls(DEFAULTS, *layers)
        for each in overrides:
            name, sep, value = each.partition("=")
            if not sep or not name:
                raise ValueError(f"{each!r} is no override")
            try:
                read = json.loads(value)
            except ValueError:
                read = value
            out = out.with_value(name, read)
        return out

    @property
    def model_name(self) -> str:
        return str(self.get("model.name", ""))

    @property
    def dataset(self) -> dict[str, Any]:
        return self.section("data")

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self._tree
        for key in name.split("."):
            if not isinstance(at, Mapping) or key not in at:
                return default
            at = at[key]
        return at

    def require(self, name: str) -> Any:
        missing = object()
        found = self.get(name, missing)
        if found is missing:
            raise MissingSetting(name)
        return found

    def section(self, name: str) -> dict[str, Any]:
        return copy.deepcopy(self.get(name) or {})

    def with_value(self, name: str, value: Any) -> Settings:
        layer: Any = value
        for key in reversed(name.split(".")):
            layer = {key: layer}
        return Settings(self._tree, layer)

    def to_dict(self) -> dict[str, Any]:
        return copy.deepcopy(self._tree)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self._tree, indent=2, ensure_ascii=False), encoding="utf-8")
