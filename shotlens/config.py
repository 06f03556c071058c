"""Run parameters: layers of values, typed rules made of them, and paths relative to a project's root."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from typing import Any, TypeVar

from pyspark.sql import SparkSession

from shotlens.sources.readers import require

R = TypeVar("R")


def merged(*layers: Mapping[str, Any] | None) -> dict[str, Any]:
    """Layers from the weakest (defaults) to the strongest (what a caller passes): a later value wins unless it is None;
    mappings are merged key by key."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, Mapping):
                out[k] = merged(out.get(k) if isinstance(out.get(k), Mapping) else None, v)
            elif v is not None or k not in out:
                out[k] = v
    return out


def parse(text: str) -> dict[str, Any]:
    """A mapping from JSON, or from YAML where a YAML library is installed."""
    try:
        got = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("no JSON, and no YAML library is installed") from None
        got = yaml.safe_load(text)
    if not isinstance(got or {}, Mapping):
        raise ValueError("parameters have to be a mapping")
    return dict(got or {})


def load(spark: SparkSession, *paths: str) -> dict[str, Any]:
    """The files' mappings as layers, the first one the weakest; a file that isn't there is an error that names it."""
    layers = []
    for path in paths:
        require(spark, path)
        layers.append(parse(spark.read.text(path, wholetext=True).head()["value"]))  # one small file
    return merged(*layers)


def rules(kind: type[R], values: Mapping[str, Any]) -> R:
    """A dataclass of rules from values with its fields' names; unknown names are an error."""
    known = {f.name for f in dataclasses.fields(kind)}
    if wrong := sorted(set(values) - known):
        raise ValueError(f"{kind.__name__} has no {', '.join(wrong)}")
    return kind(**values)


def resolve(path: str, root: str) -> str:
    """Absolute paths and URLs as they are, others below the root."""
    return path if path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"
